"""Structured Streaming jobs: the batch transforms, unchanged, over an unbounded prompt table.

Screening is stateless per row, so there is no watermark and no state except in the running
count. All jobs run what is available and stop; pass ``trigger`` to keep them running. Output and
checkpoints live in the shared folder, and every sink is idempotent per micro-batch, so a retried
batch after a lost executor or driver leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.intake import accepted
from tidegate.operators.reports import verdict_counts
from tidegate.plans.chain import screen
from tidegate.plans.stages import Stage
from tidegate.session import shared_dir
from tidegate.sources.sinks import split_outcomes, write_intake


def _run(writer: Any, home: str, trigger: dict[str, Any] | None) -> None:
    query = writer.option("checkpointLocation", f"{home}/checkpoint").trigger(
        **(trigger or {"availableNow": True})
    ).start()
    query.awaitTermination()


def _made(spark: SparkSession, path: str) -> None:
    """Create a table's folder, for streams that had nothing to write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def screen_to_table(prompts: DataFrame, stages: Sequence[Stage], home: str | None = None,
                    trigger: dict[str, Any] | None = None) -> DataFrame:
    """Validate and screen a prompt stream into a parquet table; returns that table."""
    spark = prompts.sparkSession
    home = home or shared_dir(spark, "screened")
    verdicts = screen(accepted(prompts), stages)
    table = f"{home}/verdicts"
    _run(verdicts.writeStream.format("parquet").option("path", table), home, trigger)
    return spark.read.schema(verdicts.schema).parquet(table)


def split_to_tables(prompts: DataFrame, home: str | None = None,
                    trigger: dict[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected prompts from one pass over the stream.

    Each micro-batch is written once, partitioned by outcome, under its own batch number; the two
    tables are partition-pruned views of it.
    """
    spark = prompts.sparkSession
    home = home or shared_dir(spark, "intake")

    def write(batch: DataFrame, number: int) -> None:
        write_intake(batch, f"{home}/rows/batch={number}", "overwrite")

    _run(prompts.writeStream.foreachBatch(write), home, trigger)
    _made(spark, f"{home}/rows")
    shape = split_outcomes(prompts).schema.add("batch", "long")
    rows = spark.read.schema(shape).option("basePath", f"{home}/rows").parquet(f"{home}/rows").drop("batch")
    accepted_rows = rows.where(F.col("outcome") == "accepted").drop("outcome", "reject_reason")
    return accepted_rows, rows.where(F.col("outcome") == "rejected").drop("outcome")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a table, lowest first."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(status.getPath().getParent().getName().removeprefix("batch=")) for status in found or [])


def _forget(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def count_to_table(prompts: DataFrame, stages: Sequence[Stage], *dimensions: str, home: str | None = None,
                   trigger: dict[str, Any] | None = None, keep: int = 2) -> DataFrame:
    """Running verdict counts. A micro-batch yields the new counts of the keys that it touched; they are laid over
    the newest version before its own number and written under that number, and versions before the
    last ``keep`` go. A batch that is retried starts from the same version again, and a reader takes the newest
    finished one, so neither ever meets half a table, and the table never holds more than ``keep`` versions."""
    spark = prompts.sparkSession
    home = home or shared_dir(spark, "counts")
    table = f"{home}/counts"
    counts = verdict_counts(screen(accepted(prompts), stages), *dimensions)
    shape, keys = counts.schema, [*dimensions, "label", "code"]

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        older = [n for n in _versions(session, table) if n < number]
        rows = batch.withColumn("_age", F.lit(1))
        if older:
            before = session.read.schema(shape).parquet(f"{table}/batch={older[-1]}")
            rows = rows.unionByName(before.withColumn("_age", F.lit(0)))
        merged = rows.groupBy(*keys).agg(F.max_by("prompts", "_age").alias("prompts"))
        merged.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch={number}")
        for n in older[: max(0, len(older) + 1 - max(keep, 2))]:
            _forget(session, f"{table}/batch={n}")

    _run(counts.writeStream.outputMode("update").foreachBatch(write), home, trigger)
    last = _versions(spark, table)[-1:]
    if not last:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{table}/batch={last[0]}")
