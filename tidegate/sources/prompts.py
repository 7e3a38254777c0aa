"""Prompt sources: tables, text lines and JSON requests, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.model import PROMPT


def spread(df: DataFrame, key: str = "prompt_id", partitions: int | None = None) -> DataFrame:
    """Use every core on an input that arrives in few splits; leave well-split inputs alone.

    Matching is CPU-bound, so one large row group on one core wastes the cluster. Rows are hashed
    on their unique id (balanced, and repeatable after an executor loss, without the sort that a
    round-robin repartition needs). With ``partitions=None`` the shuffle happens only where fewer
    files than cores were found *and* the whole input is at most a few splits per core, so its
    cost is bounded by the cluster's own size and never applies to a 100 TB scan.
    """
    if partitions is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() > 4 * cores or not 0 < len(df.inputFiles()) < cores:
            return df
        partitions = 2 * cores
    return df.repartition(partitions, key)


def from_table(df: DataFrame, prompt_id: str | Column, text: str | Column,
               session_id: str | Column | None = None, *keep: str | Column) -> DataFrame:
    """Project any table to the prompt columns; ``keep`` rides along for the reports."""
    session = F.lit(None) if session_id is None else _col(session_id)
    return df.select(
        _col(prompt_id).cast("string").alias("prompt_id"),
        _col(text).alias("text"),
        session.cast("string").alias("session_id"),
        *keep,
    )


def read_prompts(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A stored prompt table with the declared schema (no inference)."""
    return spark.read.schema(PROMPT).format(file_format).load(path)


def stream_prompts(spark: SparkSession, path: str, file_format: str = "parquet",
                   files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PROMPT).format(file_format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON request bodies, one per line, parsed by :func:`parse_requests`."""
    return parse_requests(spark.read.text(path), "value")


def parse_requests(df: DataFrame, body: str, *keep: str | Column) -> DataFrame:
    """Strict parse of ``{"text": ..., "session_id": ...}``.

    Numbers are not strings here, so types are read off the parsed value instead of being cast.
    ``shape_error`` says why a body cannot be a prompt; null text is left to ``validate``.
    """
    value = F.try_parse_json(F.col(body))
    parsed = df.withColumn("_v", value).withColumn("_shape", F.schema_of_variant("_v"))
    text_kind = F.schema_of_variant(F.variant_get("_v", "$.text", "variant"))
    session_kind = F.schema_of_variant(F.variant_get("_v", "$.session_id", "variant"))
    shape_error = (
        F.when(F.col("_v").isNull() | ~F.col("_shape").startswith("OBJECT"), F.lit("malformed"))
        .when(~F.coalesce(text_kind, F.lit("VOID")).isin("STRING", "VOID"), F.lit("not_text"))
        .when(~F.coalesce(session_kind, F.lit("VOID")).isin("STRING", "VOID"), F.lit("bad_session"))
    )
    ok = F.col("shape_error").isNull()
    return parsed.withColumn("shape_error", shape_error).select(
        *keep,
        F.when(ok, F.try_variant_get("_v", "$.text", "string")).alias("text"),
        F.when(ok, F.try_variant_get("_v", "$.session_id", "string")).alias("session_id"),
        "shape_error",
    )


def _col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name
