"""Validation of raw prompts: one pass decides, two filters read the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.text import is_blank, strip
from tidegate.model import MAX_CHARS


def reject_reason(text: Column) -> Column:
    """Length counts code points of the *raw* text; blankness is judged after stripping."""
    size = F.length(text)
    return (
        F.when(text.isNull(), F.lit("missing"))
        .when(size < 1, F.lit("too_short"))
        .when(size > MAX_CHARS, F.lit("too_long"))
        .when(is_blank(text), F.lit("blank"))
    )


def judge(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (null = accepted). A ``shape_error`` from the JSON intake wins."""
    reason = reject_reason(F.col("text"))
    if "shape_error" in df.columns:
        reason = F.coalesce(F.col("shape_error"), reason)
    return df.withColumn("reject_reason", reason)


def accepted(df: DataFrame) -> DataFrame:
    """Prompts fit for screening, text stripped."""
    extra = [c for c in ("shape_error", "reject_reason") if c in df.columns]
    kept = judge(df).where(F.col("reject_reason").isNull())
    return kept.drop("reject_reason", *extra).withColumn("text", strip(F.col("text")))


def rejected(df: DataFrame) -> DataFrame:
    """Everything :func:`accepted` leaves out, with the reason."""
    return judge(df).where(F.col("reject_reason").isNotNull()).drop("shape_error")


def with_correlation_id(df: DataFrame, given: str = "correlation_id", *basis: str) -> DataFrame:
    """Keep a given id, else make one.

    With ``basis`` columns the id is a digest in UUID layout, so recomputed partitions and
    replayed batches agree; without, it is random per run.
    """
    if basis:
        digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(b), F.lit("")) for b in basis]), 256)
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        made = F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cuts])
    else:
        made = F.expr("uuid()")
    present = F.col(given) if given in df.columns else F.lit(None).cast("string")
    return df.withColumn(given, F.coalesce(present, made))
