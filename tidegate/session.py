"""Session helpers: local builder for tests, shared scratch space, size-checked broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this many rows and bytes; anything larger is shuffle-joined.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegate")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``.

    A machine-local folder is used only where the master is local and the setting is absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tidegate-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def broadcast_if_small(
    side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after measuring ``side`` up to the bounds; else leave it to a shuffle.

    One row past the row bound settles the question, so the measurement is bounded as well.
    """
    sizes = [
        F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)).cast("long")
        for name in side.columns
    ]
    measured = side.limit(max_rows + 1).select(sum(sizes, F.lit(0)).alias("bytes")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )
    found = measured.first()
    fits = found["rows"] <= max_rows and found["bytes"] <= max_bytes
    return (F.broadcast(side) if fits else side), fits


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per session.

    Only needed where a stage runs Python and the cluster does not have the package installed.
    """
    context = spark.sparkContext
    if getattr(context, "_tidegate_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # the package came in an archive, which the workers have as well
        context._tidegate_shipped = True
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tidegate-"), "tidegate")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "tidegate"))
    context._tidegate_shipped = True
