"""Importance resampling of documents towards a target corpus, by hashed n-grams.

*Scores.* Runs of one to three words are hashed into ``BUCKETS`` buckets. The counts of both corpora are
summed up per task and then per bucket, so two arrays of ``BUCKETS`` numbers are all that a model is. A
document's weight is the sum of its features' gains in that array, its score the weight plus Gumbel
noise that its key alone decides. An n-gram's checksum is put together from those of its words, which
the linearity of CRC-32 allows, so no n-gram is ever spelled out.

*Selection.* The best documents are found by a distributed quickselect. Each round draws a few random
pivot keys from the rows that are still open, counts in one aggregate how many rows lie below, at
and above each of them, and goes on between the two pivots that enclose the wanted place, until a
pivot is that place's key. Only rows up to that key are sorted, by ranges, and ranked; no task or
driver ever holds them all.

Cases: null and empty texts have no features and weight 0; documents under ``LEAST_WORDS`` words are
scored but never drawn; ties go to the smaller key, rows without a key come after those with one,
and rows that share key and score are ordered by their counts; a null key's noise is that of the empty
string; an empty corpus gives no rows, an empty target a model without its counts; texts are read
whole, cut into spans that a task can hold; columns beyond the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import raw, start, written
from tidegate.session import broadcast_if_small

BUCKETS = 10_000
LONGEST = 3  # words of a feature
LEAST_WORDS = 20
SHARE = 5  # percent of the documents that are long enough
SEED = 42
PIVOTS = 15  # of a round
RANKED_PER_PART = 200_000
SPAN_BYTES = 2_000_000  # of text whose words a task holds at a time

# --- checksums of n-grams ------------------------------------------------------------------------

# Bytes that end a word become blanks, A-Z small letters.
_LETTERS = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
_DIRECT = 64  # shifts by fewer bytes are looked up at once


def _step_table() -> np.ndarray:
    """What one byte does to a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _shift(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The register after the zero bytes that ``tables`` (4 x 256) stand for."""
    return (
        tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24]
    )


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to ``_DIRECT`` - 1 zero bytes, and for every power of two of them."""
    step = _step_table()
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    direct = [at]
    for _ in range(_DIRECT - 1):
        at = step[at & 0xFF] ^ (at >> np.uint32(8))
        direct.append(at)
    powers = [direct[1]]
    while len(powers) < 40:
        powers.append(_shift(powers[-1], powers[-1]))
    return np.stack(direct), powers


_DIRECT_TABLES, _POWER_TABLES = _shift_tables()


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ``a + b`` from those of ``a`` and ``b`` and the number of bytes in ``b``."""
    near = np.minimum(length, _DIRECT - 1)
    t = _DIRECT_TABLES
    out = (
        t[near, 0, left & 0xFF] ^ t[near, 1, (left >> 8) & 0xFF] ^ t[near, 2, (left >> 16) & 0xFF] ^ t[near, 3, left >> 24]
    )
    far = np.flatnonzero(length >= _DIRECT)
    if len(far):
        crc, rest = left[far], length[far]
        for k, tables in enumerate(_POWER_TABLES):
            bit = np.flatnonzero((rest >> k) & 1)
            if len(bit):
                crc[bit] = _shift(tables, crc[bit])
        out[far] = crc
    return out ^ right


def _spans(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """A text's words in spans of bounded size, each after the words it shares with the one before."""
    text = text.translate(_LETTERS)
    at, carried = 0, []
    while at < len(text):
        end = at + SPAN_BYTES
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        new = text[at:end].split()
        if new:
            words = carried + new
            yield words, len(carried)
            carried = words[-(LONGEST - 1) :]
        at = end


def _held(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of many texts at a time, the number of the text each is in, and whether it is carried."""
    words, rows, old, size = [], [], [], 0
    for i, text in enumerate(texts):
        for part, carried in _spans(text or b""):
            words += part
            rows.append(np.full(len(part), i))
            old.append(np.arange(len(part)) < carried)
            size += sum(map(len, part))
            if size >= SPAN_BYTES:
                yield words, np.concatenate(rows), np.concatenate(old)
                words, rows, old, size = [], [], [], 0
    if words:
        yield words, np.concatenate(rows), np.concatenate(old)


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket and text number of every feature, and the text number of every word, some texts at a time.

    A span begins with the words carried over; features that end in one of these were counted before.
    """
    blank = np.uint32(zlib.crc32(b" "))
    for words, rows, old in _held(texts):
        crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        behind = joined(np.full(len(words), blank), crc, length)  # of the word with a blank before it
        # Carried words follow their own copies in the same text, so a span's start must be told apart.
        begins = old & ~np.concatenate([[False], old[:-1]])
        span = np.cumsum(begins)
        buckets, owners, run = [crc[~old]], [rows[~old]], crc
        for n in range(2, LONGEST + 1):
            run = joined(run[:-1], behind[n - 1 :], length[n - 1 :] + 1)
            m = len(run)
            whole = (rows[:m] == rows[n - 1 :]) & (span[:m] == span[n - 1 :]) & ~old[n - 1 :]
            buckets.append(run[whole])
            owners.append(rows[:m][whole])
        yield np.concatenate(buckets) % np.uint32(BUCKETS), np.concatenate(owners), rows[~old]


# --- model ---------------------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features per bucket over a whole table: summed up in each task, then per bucket."""

    def count(batches):
        held = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for buckets, _, _ in features(raw(batch, "text")):
                held += np.bincount(buckets, minlength=BUCKETS)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["bucket", "n"])

    start(texts.sparkSession)
    per_task = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (s_all + BUCKETS)) / ((s + 1) * (t_all + BUCKETS))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def noise(key: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, decided by the seed and the key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n_features, n_words, weight, score) of every document."""

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            n_features, weight, n_words = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for buckets, rows, words in features(raw(batch, "text")):
                n_features += np.bincount(rows, minlength=n)
                n_words += np.bincount(words, minlength=n)
                # Doubles hold these sums exactly up to 2^53.
                weight += np.bincount(rows, weights=model[buckets], minlength=n).astype(np.int64)
            drawn = [noise(k, seed) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n_features, n_words, weight, weight + np.array(drawn, dtype=np.int64)))],
                names=[key, "n_features", "n_words", "weight", "score"],
            )

    start(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        score, f"{key} {kind}, n_features long, n_words long, weight long, score long"
    )


# --- selection -----------------------------------------------------------------------------------


def _place(key: str) -> Column:
    """What rows are ordered by: better scores first; equal places belong to equal rows."""
    return F.struct(
        (-F.col("score")).alias("a"),
        F.col(key).isNull().alias("b"),
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("c"),
        F.col("n_features").alias("d"),
        F.col("weight").alias("e"),
    )


def _literal(place) -> Column:
    return F.struct(*[F.lit(value).cast("boolean" if name == "b" else "long").alias(name) for name, value in place.asDict().items()])


def kth(rows: DataFrame, k: int, seed: int = SEED):
    """The ``k``-th smallest of the column ``place`` (from 1): quickselect with random pivots.

    ``rows`` must be a written table. A round leaves about one in ``PIVOTS`` rows open; pivots are rows
    that are open, so every round closes some.
    """
    low = high = None
    round_ = 0
    while True:
        open_ = rows
        if low is not None:
            open_ = open_.where((F.col("score") <= F.lit(-low["a"])) & (F.col("place") > _literal(low)))
        if high is not None:
            open_ = open_.where((F.col("score") >= F.lit(-high["a"])) & (F.col("place") < _literal(high)))
        # One random row of each random group: as many rows as pivots, combined before any shuffle.
        drawn = open_.select("place", F.rand(seed + round_).alias("r"))
        pivots = sorted(
            {
                row["p"]
                for row in drawn.groupBy(F.floor(F.col("r") * PIVOTS).alias("g")).agg(F.min_by("place", "r").alias("p")).collect()
            }
        )
        sides = [
            side
            for i, p in enumerate(pivots)
            for side in (
                F.count_if(F.col("place") < _literal(p)).alias(f"less{i}"),
                F.count_if(F.col("place") == _literal(p)).alias(f"same{i}"),
            )
        ]
        counts = open_.agg(*sides).first()
        below = 0  # open rows up to the pivot before
        for i, p in enumerate(pivots):
            less, same = counts[f"less{i}"], counts[f"same{i}"]
            if less < k <= less + same:
                return p
            if k <= less:
                high = p
                break
            low, below = p, less + same
        k -= below
        round_ += 1


def draw(rows: DataFrame, key: str = "doc_id", share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` (from 1, best first) to the best ``share`` percent of the rows that are long enough."""
    rows = written(rows.withColumn("place", _place(key)), "scored")
    long_enough = rows.where(F.col("n_words") >= least_words)
    k = share * long_enough.count() // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("place")
    last = _literal(kth(long_enough, k))
    wins = (F.col("n_words") >= least_words) & (F.col("place") <= last)
    n = -(-k // RANKED_PER_PART)
    # Ranges are written with their number, so that a lost task cannot move a row to another range.
    ranges = rows.where(wins).repartitionByRange(max(n, 1), "place").withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(  # a row a range, of RANKED_PER_PART winners each
        "range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("place"))
    ranked = ranges.join(broadcast_if_small(before)[0], "range").withColumn("rank", rank.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("range", "before")
    return rows.where(~wins).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked).drop("place")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, rank null where not drawn."""
    model = gains(bucket_counts(docs), bucket_counts(target))
    return draw(scored(docs, model)).select("doc_id", "n_features", "weight", "score", "rank")
