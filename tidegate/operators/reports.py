"""Aggregate reports over verdicts, traces and predictions.

Every aggregation here is over a small key (label, source, stage, trigger), so Spark's partial
aggregation reduces each partition to a handful of rows before the shuffle, however skewed the
key is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.labels import gate, normalise_label
from tidegate.operators.rules import all_patterns, keyword_hits, match_columns
from tidegate.sources.banks import Banks


def verdict_rollup(verdicts: DataFrame, dimension: str = "source") -> DataFrame:
    """Counts by dimension and label with subtotals and the grand total (``level`` tells which)."""
    return (
        verdicts.rollup(dimension, "label")
        .agg(F.count(F.lit(1)).alias("prompts"), F.grouping_id().alias("level"))
        .select(dimension, "label", F.col("level").cast("int").alias("level"), "prompts")
    )


def verdict_counts(verdicts: DataFrame, *dimensions: str) -> DataFrame:
    return verdicts.groupBy(*dimensions, "label", "code").agg(F.count(F.lit(1)).alias("prompts"))


def stage_funnel(inspected: DataFrame) -> DataFrame:
    """Executed, blocked, skipped and failed prompts per stage, in one pass."""

    def events(stage: Column, ran: int, blocked: Column, failed: Column) -> Column:
        return F.struct(
            stage.alias("stage"),
            F.lit(ran).alias("executed"),
            F.lit(1 - ran).alias("skipped"),
            blocked.cast("int").alias("blocked"),
            failed.cast("int").alias("failed"),
        )

    no = F.lit(False)
    ran = F.transform("trace", lambda e: events(e["stage"], 1, e["short_circuit"], no))
    fell = F.transform(
        "skipped_stages",
        lambda s: events(s, 0, no, F.coalesce(s == F.col("failed_stage"), no)),
    )
    rows = inspected.select(F.explode(F.concat(ran, fell)).alias("e")).select("e.*")
    counts = [F.sum(c).alias(c) for c in ("executed", "blocked", "skipped", "failed")]
    return rows.groupBy("stage").agg(*counts)


def observed_funnel(spark: SparkSession, stages: Sequence[Any], seen: Mapping[str, Any]) -> DataFrame:
    """The counts of :func:`stage_funnel`, with the milliseconds of timed stages, from an observation."""
    names = ("executed", "skipped", "blocked", "failed")
    rows = [
        (stage.name, *(int(seen[f"{name}_{order}"] or 0) for name in names), seen[f"stage_ms_{order}"])
        for order, stage in enumerate(stages)
    ]
    shape = ", ".join(f"{name} long" for name in names)
    return spark.createDataFrame(rows, f"stage string, {shape}, stage_ms double")


def top_triggers(verdicts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent triggers, ties in alphabetical order."""
    trigger = F.col("data.metadata")["triggered_by"]
    counted = verdicts.select(trigger.alias("triggered_by"), "label").where(
        F.col("triggered_by").isNotNull()
    )
    counted = counted.groupBy("triggered_by", "label").agg(F.count(F.lit(1)).alias("prompts"))
    return counted.orderBy(F.desc("prompts"), "triggered_by", "label").limit(k)


def length_profile(verdicts: DataFrame) -> DataFrame:
    """Text length by label. Lengths are bounded, so the exact percentile's buffer is too.

    Failed prompts carry no text any more and count as length 0.
    """
    size = F.length("data.processed_text")
    return (
        verdicts.select("label", size.alias("size"))
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("prompts"),
            F.min("size").alias("min_chars"),
            F.max("size").alias("max_chars"),
            F.avg("size").alias("avg_chars"),
            F.percentile("size", F.lit(0.5)).alias("p50_chars"),
            F.percentile("size", F.lit(0.95)).alias("p95_chars"),
        )
    )


def keyword_usage(prompts: DataFrame, banks: Banks) -> DataFrame:
    """Every bank keyword with the number of prompts it was found in (0 if none)."""
    counts = (
        keyword_hits(prompts, banks).groupBy("bank", "keyword").agg(F.count(F.lit(1)).alias("prompts"))
    )
    bank = banks.keyword_frame(prompts.sparkSession)
    # The counts are bounded by the bank, which the driver parsed: both sides are tiny.
    joined = bank.join(counts, ["bank", "keyword"], "left")
    return joined.select(
        "bank", "category", "level", "keyword", F.coalesce("prompts", F.lit(0)).alias("prompts")
    )


def pattern_usage(prompts: DataFrame, banks: Banks) -> DataFrame:
    """Every pattern with the number of prompts it matches, shadowed or not."""
    hits = match_columns(prompts, ids=all_patterns(banks.patterns)).select(F.explode("ids").alias("id"))
    counts = hits.groupBy("id").agg(F.count(F.lit(1)).alias("prompts"))
    bank = banks.patterns.frame(prompts.sparkSession)
    return bank.join(counts, "id", "left").select(
        "ord", "id", "description", "pattern", F.coalesce("prompts", F.lit(0)).alias("prompts")
    )


def bank_inventory(usage: DataFrame) -> DataFrame:
    """Size and use of each bank category, from :func:`keyword_usage`."""
    return usage.groupBy("bank", "category").agg(
        F.max("level").alias("level"),
        F.count_distinct("keyword").alias("keywords"),
        F.count_if(F.col("prompts") > 0).alias("keywords_hit"),
        F.sum("prompts").alias("hits"),
    )


def unmapped_labels(scored: DataFrame, labels: Mapping[str, str], raw: str = "raw_label") -> DataFrame:
    """Raw labels the map does not know, with their counts. The map holds a few entries and is
    folded into the filter instead of being joined."""
    known = F.upper(F.col(raw)).isin(*labels)
    return (
        scored.where(F.col(raw).isNotNull() & ~known)
        .groupBy(raw)
        .agg(F.count(F.lit(1)).alias("prompts"))
    )


def gate_report(scored: DataFrame, labels: Mapping[str, str], threshold: float) -> DataFrame:
    """Per mapped label: how many predictions the threshold kept and how many it downgraded."""
    mapped = normalise_label(F.col("raw_label"), labels)
    gated = scored.select(mapped.alias("mapped"), "score").withColumn(
        "final", gate(F.col("mapped"), F.col("score"), threshold)
    )
    return gated.groupBy("mapped").agg(
        F.count_if(F.col("final") == F.col("mapped")).alias("kept"),
        F.count_if(F.col("final") != F.col("mapped")).alias("downgraded"),
    )


def stage_timing(inspected: DataFrame) -> DataFrame:
    """Measured milliseconds per stage; stages fused into native code report none."""
    entries = inspected.select(F.explode("trace").alias("e")).select("e.*")
    return entries.groupBy("stage").agg(
        F.count(F.lit(1)).alias("executed"),
        F.count("duration_ms").alias("timed"),
        F.round(F.sum("duration_ms"), 3).alias("total_ms"),
        F.round(F.max("duration_ms"), 3).alias("max_ms"),
    )
