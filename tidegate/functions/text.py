"""Column functions on prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's str.strip and \s treat as white space (all lie below U+3001).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(text: Column) -> Column:
    """``str.strip``: both ends, Unicode white space (``F.trim`` alone only takes blanks)."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Nothing left after stripping; looks no further than the first other character."""
    return F.ltrim(text, F.lit(WHITESPACE)) == ""


def ascii_folded(lowered: Column) -> Column:
    """Map the two lower-case letters that a case-insensitive match equates with ASCII ones.

    On this column an ASCII pattern in lower case matches case-*sensitively* exactly where it
    would match the lowered text case-insensitively, which is several times cheaper in the JVM.
    Both substitutions are one code point for one, so counted repeats keep their meaning.
    """
    rare = lowered.contains("ſ") | lowered.contains("ı")
    return F.when(rare, F.translate(lowered, "ſı", "si")).otherwise(lowered)
