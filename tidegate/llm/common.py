"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import shared_dir, ship

ROWS_AT_ONCE = 512  # texts that a column function decodes together
BATCH_BYTES = 8 * 1024 * 1024  # of what goes to a worker at a time; Spark holds this as well, for each task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def start(spark: SparkSession) -> SparkSession:
    """Give the workers this package, and rows in batches of bounded bytes; call before an operator that
    runs Python."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def kept_out(key: str = "doc_id") -> Column:
    """True for rows that no learner may see: crc32 of the key as text leaves remainder 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes, so ill-formed UTF-8 never raises."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def text_of(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


def of_texts(make, kind: str = "double"):
    """A column function of whole texts; ``make()`` gives a task its function of a list of texts. Nothing
    but the text crosses to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = make()
        for batch in batches:
            parts = [batch.slice(at, ROWS_AT_ONCE).cast(pa.binary()) for at in range(0, len(batch), ROWS_AT_ONCE)]
            found = [pa.array(score([text_of(v) for v in part.to_pylist()]), pa.float64()) for part in parts]
            yield pa.concat_arrays(found) if found else pa.array([], pa.float64())
        del score
        give_back()

    return F.arrow_udf(run, kind).asNondeterministic()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next task's may be another's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such call, memory stays with the worker
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function of batches that gives its memory back when its task ends."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def mix(x):
    """SplitMix64's finaliser over a uint64 array: public constants, wraps around."""
    import numpy as np

    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]):
    """64-bit XXH3 of every word."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(hashes, width: int):
    """One 64-bit fingerprint for every run of ``width`` consecutive word hashes."""
    import numpy as np

    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    # Doubling: blocks of 1, 2, 4 ... words, put together as the binary digits of the width ask.
    out, done, block, span, power = np.zeros(n, dtype=np.uint64), 0, hashes, 1, base
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = block[done : done + n]
                out = mix(out * power + part) if done else part.copy()
                done += span
            left >>= 1
            if left:
                block = mix(block[:-span] * power + block[span:]) if len(block) > span else block[:0]
                span *= 2
                power = power * power + np.uint64(2)
        return mix(out)


def written(df: DataFrame, purpose: str, *by: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = shared_dir(df.sparkSession, purpose)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, per_part: int, least: int = 1) -> int:
    """How many partitions hold about ``per_part`` rows each; grows with the table."""
    return max(least, -(-df.count() // per_part))


def groups(texts: list[str], letters: int):
    """Consecutive texts of about so many letters, as slices: what a task holds at a time."""
    lo, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= letters:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
