"""Merging stage results into one verdict per prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.labels import label_code, label_rank
from tidegate.model import ERROR, INTEGRITY_REASON, LABEL_CODES, STAGE_RESULT, VERDICT_DATA


def merge_wide(results: list[Column]) -> Column:
    """Highest label rank; on a tie the earliest stage. Nulls (stages not run) are passed over."""
    ranked = [
        F.when(
            result.isNotNull(),
            F.struct(
                label_rank(result["label"]).alias("rank"),
                F.lit(-order).alias("order"),
                result.alias("result"),
            ),
        )
        for order, result in enumerate(results)
    ]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return best["result"]


def merge_long(results: DataFrame) -> DataFrame:
    """The same merge over a table of stage results, one row per prompt and stage.

    Needs ``prompt_id``, ``ord``, the ``STAGE_RESULT`` fields and ``error`` (null or the failing
    stage's error). ``max_by`` combines map-side, and a group holds one row per stage.
    """
    result = F.struct(*STAGE_RESULT.names)
    order = F.when(
        F.col("error").isNull(), F.struct(label_rank(F.col("label")), -F.col("ord"))
    )
    merged = results.groupBy("prompt_id").agg(
        F.max_by(result, order).alias("best"),
        F.bool_or(F.col("error").isNotNull()).alias("failed"),
    )
    best, failed = F.col("best"), F.col("failed")
    label = F.when(failed, F.lit(ERROR)).otherwise(best["label"])
    return merged.select(
        "prompt_id",
        label_code(label).alias("code"),
        label.alias("label"),
        F.when(~failed, best["stage_name"]).alias("stage"),
        F.when(~failed, best["triggered_by"]).alias("triggered_by"),
        F.when(failed, F.lit(0.0)).otherwise(best["confidence"]).alias("score"),
    )


def metadata(result: Column) -> Column:
    """``stage`` always; ``triggered_by`` only when it is neither null nor empty."""
    named = F.create_map(F.lit("stage"), result["stage_name"])
    trigger = result["triggered_by"]
    full = F.create_map(
        F.lit("stage"), result["stage_name"], F.lit("triggered_by"), trigger
    )
    return F.when(trigger != "", full).otherwise(named)


def verdict_columns(best: Column, failed: Column, text: Column) -> list[Column]:
    """``code, label, data``. A failure hides text, score and trigger."""
    label = F.when(failed, F.lit(ERROR)).otherwise(best["label"])
    code = F.when(failed, F.lit(LABEL_CODES[ERROR])).otherwise(label_code(best["label"]))
    reason = F.create_map(F.lit("reason"), F.lit(INTEGRITY_REASON))
    data = F.struct(
        F.when(failed, F.lit("")).otherwise(text).alias("processed_text"),
        F.when(failed, F.lit(0.0)).otherwise(best["confidence"]).alias("confidence_score"),
        F.when(failed, reason).otherwise(metadata(best)).alias("metadata"),
    ).cast(VERDICT_DATA)
    return [code.alias("code"), label.alias("label"), data.alias("data")]


def flat(verdicts: DataFrame, *keep: str) -> DataFrame:
    """One scalar column per verdict field."""
    meta = F.col("data.metadata")
    return verdicts.select(
        "prompt_id",
        *keep,
        "code",
        "label",
        meta["stage"].alias("stage"),
        meta["triggered_by"].alias("triggered_by"),
        meta["reason"].alias("reason"),
        F.col("data.confidence_score").alias("score"),
        F.col("data.processed_text").alias("processed_text"),
    )


def as_json(verdicts: DataFrame, *keep: str) -> DataFrame:
    """The response body per prompt: ``{"code":…,"label":…,"data":{…}}``."""
    body = F.to_json(F.struct("code", "label", "data"))
    return verdicts.select("prompt_id", *keep, body.alias("verdict"))
