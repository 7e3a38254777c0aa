"""Whole-word keyword matching as one regular expression per bank.

Word characters are ``[0-9A-Za-z_]`` only, the leftmost hit wins, the longest keyword wins at
one start, and spaces inside a keyword are literal.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import groupby
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

def _quote(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else f"\\x{{{ord(ch):x}}}" for ch in text)


def _factored(words: list[str]) -> str:
    """Sorted distinct words as an alternation that shares prefixes and prefers longer words."""
    optional = words[0] == ""
    groups = [list(g) for _, g in groupby(words[1:] if optional else words, key=lambda w: w[0])]
    choices = []
    for group in groups:
        stem = commonprefix(group)
        rest = [w[len(stem) :] for w in group]
        choices.append(_quote(stem) + (_factored(rest) if rest != [""] else ""))
    if not optional and len(choices) == 1:
        return choices[0]
    return f"(?:{'|'.join(choices)}){'?' if optional else ''}"


def keyword_regex(folded: list[str]) -> str | None:
    """All keywords as one prefix-sharing alternation; ``None`` for an empty bank.

    On the JVM ``\\w`` is exactly the ASCII word class used here.
    """
    words = sorted(set(folded))
    return _factored(words) if words else None


def as_written(hit: Column, spelling: Mapping[str, str]) -> Column:
    """Matched lower-case form -> keyword as the bank spells it (only where the two differ)."""
    odd = {low: kw for low, kw in spelling.items() if low != kw}
    if not odd:
        return hit
    table = F.create_map(*[F.lit(x) for pair in sorted(odd.items()) for x in pair])
    return F.coalesce(F.element_at(table, hit), hit)


def _search(lowered: Column, regex: str) -> tuple[Column, str]:
    """Text and expression for finding one hit, in group 1.

    With a blank put in front, every hit has a non-word character before it to consume, which
    costs less than looking behind at each position.
    """
    return F.concat(F.lit(" "), lowered), rf"\W({regex})(?!\w)"


def has_keyword(lowered: Column, regex: str | None) -> Column:
    if regex is None:
        return F.lit(False)
    text, search = _search(lowered, regex)
    return text.rlike(search)


def extract_first(lowered: Column, regex: str) -> Column:
    """Only call where ``has_keyword`` holds: the empty string stands for no hit."""
    return F.regexp_extract(*_search(lowered, regex), 1)


def extract_all(lowered: Column, regex: str | None) -> Column:
    """Every non-overlapping hit, in text order. Neighbours share the separator between them, so
    here it is looked at, not consumed."""
    if regex is None:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(lowered, F.lit(rf"(?<!\w)({regex})(?!\w)"), F.lit(1))
