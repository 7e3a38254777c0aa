"""Verdict, trace and intake sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.text import strip
from tidegate.operators import trace as tracing
from tidegate.operators import verdict as verdicts
from tidegate.operators.intake import judge

# Columns that serve the reports only and never leave with a verdict.
_INTERNAL = ("failed_stage",)


def write_verdicts(screened: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """Verdict table; ``json`` writes one nested response per line, with the prompt's id columns."""
    screened.drop(*_INTERNAL).write.mode(mode).format(file_format).save(path)


def write_bodies(screened: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Response bodies as text lines; an inspected frame yields inspect responses."""
    if "trace" in screened.columns:
        bodies = tracing.as_json(screened).select("inspection")
    else:
        bodies = verdicts.as_json(screened).select("verdict")
    bodies.write.mode(mode).text(path)


def split_outcomes(prompts: DataFrame) -> DataFrame:
    """Every prompt with ``outcome`` accepted or rejected; accepted text is stripped."""
    good = F.col("reject_reason").isNull()
    text = F.when(good, strip(F.col("text"))).otherwise(F.col("text"))
    outcome = F.when(good, F.lit("accepted")).otherwise(F.lit("rejected"))
    return judge(prompts).drop("shape_error").withColumns({"outcome": outcome, "text": text})


def write_intake(prompts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Accepted and rejected prompts from one pass, as two partitions of one table."""
    split_outcomes(prompts).write.mode(mode).partitionBy("outcome").parquet(path)
