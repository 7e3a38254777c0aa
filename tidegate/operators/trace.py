"""Per-stage traces of a screened frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.model import TRACE_ENTRY


def trace_array(results: list[Column], failed: Column) -> Column:
    """Executed stages in order; empty when the prompt failed."""
    entries = F.array(
        *[
            F.when(
                r.isNotNull(),
                F.struct(
                    r["stage_name"].alias("stage"),
                    r["label"].alias("label"),
                    r["confidence"].alias("score"),
                    r["triggered_by"].alias("triggered_by"),
                    r["short_circuit"].alias("short_circuit"),
                    r["duration_ms"].alias("duration_ms"),
                ).cast(TRACE_ENTRY),
            )
            for r in results
        ]
    )
    nothing = F.array().cast(T.ArrayType(TRACE_ENTRY))
    return F.when(failed, nothing).otherwise(F.array_compact(entries))


def skipped(names: list[str], trace: Column) -> Column:
    """Registered names that no executed stage bears, in registration order, duplicates kept."""
    executed = F.transform(trace, lambda entry: entry["stage"])
    every = F.array(*[F.lit(name) for name in names])
    return F.filter(every, lambda name: ~F.array_contains(executed, name))


def total_ms(trace: Column) -> Column:
    """Sum of the measured stage times; native stages run fused and have none of their own."""
    times = F.transform(trace, lambda entry: F.coalesce(entry["duration_ms"], F.lit(0.0)))
    return F.round(F.aggregate(times, F.lit(0.0), lambda total, ms: total + ms), 3)


def flat_trace(inspected: DataFrame, *keep: str) -> DataFrame:
    """One row per prompt and executed stage."""
    return inspected.select("prompt_id", *keep, F.posexplode("trace").alias("ord", "entry")).select(
        "prompt_id", *keep, "ord", "entry.*"
    )


def flat_skipped(inspected: DataFrame) -> DataFrame:
    """One row per prompt and skipped stage, with the number of registered stages."""
    return inspected.select(
        "prompt_id", "total_stages", F.posexplode("skipped_stages").alias("ord", "stage")
    )


def as_json(inspected: DataFrame) -> DataFrame:
    """The inspect response per prompt."""
    body = F.struct(
        F.struct("code", "label", "data").alias("final"),
        "trace",
        "skipped_stages",
        "total_stages",
        "total_duration_ms",
    )
    return inspected.select("prompt_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("inspection"))
