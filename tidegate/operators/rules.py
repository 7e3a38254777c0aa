"""Dictionary and pattern matching over prompt text, all in native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.keywords import as_written, extract_all, extract_first, has_keyword
from tidegate.functions.plan import computed
from tidegate.functions.text import ascii_folded
from tidegate.model import CRISIS, MALIGN, RULE_STAGE, STAGE_RESULT, VALID
from tidegate.session import broadcast_if_small
from tidegate.sources.banks import Banks, KeywordBank, PatternBank

LOWERED, FOLDED = "_lowered", "_folded"


def with_matchable(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Lower the text once per row, in columns of their own, for every matcher that follows."""
    source = F.col("text") if text is None else text
    return df.withColumn(LOWERED, F.lower(source)).withColumn(FOLDED, ascii_folded(F.col(LOWERED)))


def _drop_matchable(df: DataFrame) -> DataFrame:
    return df.drop(LOWERED, FOLDED)


def first_pattern(bank: PatternBank) -> Column:
    """Id of the first pattern, in bank order, found anywhere in the text; null if none."""
    tests = [(p.jvm.matches(LOWERED, FOLDED), F.lit(p.id)) for p in bank.patterns]
    if not tests:
        return F.lit(None).cast("string")
    return reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0]))


def all_patterns(bank: PatternBank) -> Column:
    """Ids of every matching pattern, in bank order."""
    hits = [F.when(p.jvm.matches(LOWERED, FOLDED), F.lit(p.id)) for p in bank.patterns]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def first_keyword(bank: KeywordBank) -> Column:
    """Leftmost-longest whole-word keyword, as the bank spells it; null if none."""
    if bank.regex is None:
        return F.lit(None).cast("string")
    lowered = F.col(LOWERED)
    hit = as_written(extract_first(lowered, bank.regex), bank.spelling)
    return F.when(has_keyword(lowered, bank.regex), hit)


def all_keywords(bank: KeywordBank) -> Column:
    """Every non-overlapping keyword in text order, as the bank spells it."""
    hits = extract_all(F.col(LOWERED), bank.regex)
    spelling = bank.spelling
    if all(low == kw for low, kw in spelling.items()):
        return hits
    return F.transform(hits, lambda hit: as_written(hit, spelling))


def rule_hit(banks: Banks) -> Column:
    """``struct(label, triggered_by)``: pattern, else crisis keyword, else malign keyword.

    A text without any keyword is settled by one pass of the joint expression; the per-bank
    expressions run on the few rows where that pass hit.
    """

    def found(label: str, trigger: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), trigger.alias("triggered_by"))

    lowered = F.col(LOWERED)
    cases = [
        (p.jvm.matches(LOWERED, FOLDED), found(MALIGN, F.lit(f"bypass:{p.id}")))
        for p in banks.patterns.patterns
    ]
    clean = found(VALID, F.lit(None).cast("string"))
    cases.append((~has_keyword(lowered, banks.any_keyword_regex), clean))
    for label, bank in ((CRISIS, banks.crisis), (MALIGN, banks.malign)):
        if bank.regex is not None:
            hit = as_written(extract_first(lowered, bank.regex), bank.spelling)
            trigger = F.concat(F.lit("keyword:"), hit)
            cases.append((has_keyword(lowered, bank.regex), found(label, trigger)))
    case = reduce(lambda c, t: c.when(*t), cases[1:], F.when(*cases[0]))
    return case.otherwise(clean)


def rule_result(hit: Column) -> Column:
    """A rule hit as a stage result: confidence 1, blocking unless Valid."""
    return F.struct(
        F.lit(RULE_STAGE).alias("stage_name"),
        hit["label"].alias("label"),
        F.lit(1.0).alias("confidence"),
        hit["triggered_by"].alias("triggered_by"),
        (hit["label"] != VALID).alias("short_circuit"),
        F.lit(None).cast("double").alias("duration_ms"),
    ).cast(STAGE_RESULT)


def match_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add matcher outputs to prompts, e.g. ``match_columns(p, hit=first_keyword(bank))``."""
    prepared = with_matchable(df)
    for name, column in columns.items():
        prepared = computed(prepared, **{name: column})
    return _drop_matchable(prepared)


def keyword_hits(prompts: DataFrame, banks: Banks) -> DataFrame:
    """``(prompt_id, bank, keyword)``, each keyword once per prompt, from one pass over the text."""

    def tagged(bank: str) -> Column:
        return F.transform(bank, lambda kw: F.struct(F.lit(bank).alias("bank"), kw.alias("keyword")))

    found = match_columns(
        prompts,
        crisis=F.array_distinct(all_keywords(banks.crisis)),
        malign=F.array_distinct(all_keywords(banks.malign)),
    )
    both = F.concat(tagged("crisis"), tagged("malign"))
    return found.select("prompt_id", F.explode(both).alias("hit")).select("prompt_id", "hit.*")


def severity(hits: DataFrame, banks: Banks, keyword: str = "keyword", bank: str = "bank") -> DataFrame:
    """Left equi-join of keyword hits with their category and level; the bank's frame is broadcast
    only if its measured size allows."""
    side = banks.keyword_frame(hits.sparkSession).select(
        F.col("bank").alias(bank), F.col("keyword").alias(keyword), "category", "level"
    )
    return hits.join(broadcast_if_small(side)[0], [bank, keyword], "left")
