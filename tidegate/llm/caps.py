"""Embedding near-dedup by spherical-cap filters.

Filters are directions of a structured random product code: the components are dealt into blocks,
each block has its own random codewords, and a filter joins one codeword of every block. A vector
is list-decoded, block by block with what the blocks to come can add at most, to all filters whose inner
product reaches the threshold, and at least to its ``FEWEST`` best. Vectors of one label that share a
filter are compared exactly, in double precision.

The number of filters follows the number of vectors, so caps hold about as many vectors at any
size; caps that hold more than ``BLOCK`` are compared block against block. Equal vectors are one class
from the start. A pair is counted only in the first filter that both vectors have, and what leaves
a task is a number of links and a root for each vector, never all pairs.

Cases: rows with a null label, a null or zero vector, or with null or non-finite components link with
nothing; so do vectors of different lengths; rows with a null id get a null component; rows that
repeat an id are vectors of their own with one component; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import start, written
from tidegate.llm.components import components

COSINE = 0.98
BLOCKS = 3
LISTED = 12  # filters a vector has on average
FEWEST = 5
CAP_ROWS = 100  # vectors of a label that a filter holds on average
BLOCK = 1_024
SAMPLE = 2_000  # vectors of random direction that set the threshold
TASK_ROWS = 8_000


@lru_cache(maxsize=8)
def code(width: int, words: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], float]:
    """Components and codewords of each block, and the threshold met ``LISTED`` times on average."""
    rng = np.random.default_rng(width * 1_000_003 + words)
    blocks = min(BLOCKS, width)
    parts = tuple(np.sort(p) for p in np.array_split(rng.permutation(width), blocks))
    books = []
    for part in parts:
        book = rng.normal(size=(words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * np.sqrt(len(part) / width))
    some = rng.normal(size=(SAMPLE, width))
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    total = np.zeros((SAMPLE, 1))
    for part, book in zip(parts, books, strict=True):
        total = (total[:, :, None] + (some[:, part] @ book.T)[:, None, :]).reshape(SAMPLE, -1)
        keep = min(total.shape[1], 50 * LISTED * words)
        total = np.sort(total, axis=1)[:, -keep:]
    every = np.sort(total.ravel())
    return parts, tuple(books), float(every[-min(len(every), SAMPLE * LISTED)])


def decode(units: np.ndarray, words: int) -> list[np.ndarray]:
    """Each unit vector's filters in rising order: all that reach the threshold, the best at least."""
    parts, books, least = code(units.shape[1], words)
    gains = [units[:, part] @ book.T for part, book in zip(parts, books, strict=True)]
    ahead = np.cumsum([g.max(1) for g in gains][::-1], axis=0)[::-1]
    # A vector that the threshold leaves too few filters goes by its own: enough of its best sums.
    few = max(2, round(FEWEST ** (1 / len(books))) + 1)
    reach = np.zeros((len(units), 1))
    for gain in gains:
        top = -np.sort(-gain, axis=1)[:, :few]
        reach = (reach[:, :, None] + top[:, None, :]).reshape(len(units), -1)
    reach = -np.sort(-reach, axis=1)
    need = np.minimum(least, reach[:, min(FEWEST, reach.shape[1]) - 1])
    owner, number, total = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
    for b, gain in enumerate(gains):
        after = ahead[b + 1] if b + 1 < len(gains) else np.zeros(len(units))
        total = total[:, None] + gain[owner]
        which, word = np.nonzero(total + after[owner][:, None] >= need[owner][:, None] - 1e-12)
        total, number, owner = total[which, word], number[which] * words + word, owner[which]
    order = np.lexsort((number, owner))
    edges = np.searchsorted(owner[order], np.arange(len(units) + 1))
    return [number[order][edges[i] : edges[i + 1]] for i in range(len(units))]


def filtered(classes: DataFrame, words: int) -> DataFrame:
    """``classes`` (id, grp, vector, copies) with the unit vector as bytes and its filters."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            units, lists = [None] * len(vectors), [None] * len(vectors)
            widths = np.array([len(v) for v in vectors])
            for width in np.unique(widths):
                at = np.nonzero(widths == width)[0]
                for lo in range(0, len(at), 512):
                    some = at[lo : lo + 512]
                    raw = np.array([vectors[i] for i in some], dtype=np.float64)
                    raw /= abs(raw).max(1, keepdims=True)
                    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                    for i, u, found in zip(some, unit, decode(unit, words), strict=True):
                        units[i], lists[i] = u.tobytes(), found.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(units, pa.binary()),
                    batch.column(3),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                ["id", "grp", "unit", "copies", "filters"],
            )

    return classes.select("id", "grp", "vector", "copies").mapInArrow(
        run, "id long, grp string, unit binary, copies long, filters array<long>"
    )


def _linked(units: np.ndarray, across: np.ndarray, lists: list, now: int, least: float) -> np.ndarray:
    """Matrix of the pairs of a cap that link and have no earlier filter in common."""
    ok = units @ units.T >= least
    ok &= across
    rows = np.nonzero(ok.any(1))[0]
    if not len(rows):
        return ok
    sizes = [int(np.searchsorted(lists[i], now)) for i in rows]
    earlier = np.concatenate([lists[i][:n] for i, n in zip(rows, sizes, strict=True)])
    if len(earlier):
        kinds, column = np.unique(earlier, return_inverse=True)
        has = np.zeros((len(rows), len(kinds)), dtype=np.float32)
        has[np.repeat(np.arange(len(rows)), sizes), column] = 1
        ok[np.ix_(rows, rows)] &= has @ has.T == 0
    return ok


def compared(posts: DataFrame, least: float = COSINE) -> DataFrame:
    """(id, links, root): from every cap, how many vectors each one links with and whom it hangs on."""
    dealt = posts.withColumn("filter", F.explode("filters"))
    large = dealt.groupBy("grp", "filter").count().where(F.col("count") > BLOCK)
    large = large.select("grp", "filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        dealt.join(large, ["grp", "filter"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("grp", "filter", "low", "high", "id")])
        grp, now, low, high, mine, ids, copies = (
            np.array(table.column(c).to_pylist(), dtype=object if c == "grp" else np.int64)
            for c in ("grp", "filter", "low", "high", "mine", "id", "copies")
        )
        units, lists = table.column("unit").to_pylist(), table.column("filters").to_pylist()
        new = (grp[1:] != grp[:-1]) | (now[1:] != now[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edges = [0, *(np.nonzero(new)[0] + 1).tolist(), len(ids)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            unit = np.stack([np.frombuffer(u) for u in units[lo:hi]])
            across = ~np.eye(hi - lo, dtype=bool)
            if low[lo] != high[lo]:
                across &= mine[lo:hi, None] != mine[None, lo:hi]
            ok = _linked(unit, across, [np.array(x) for x in lists[lo:hi]], int(now[lo]), least)
            rows = np.nonzero(ok.any(1))[0]
            if not len(rows):
                continue
            ok, here = ok[np.ix_(rows, rows)], ids[lo:hi][rows]
            root = here.copy()
            while True:
                near = np.minimum(root, np.where(ok, root[None, :], np.iinfo(np.int64).max).min(1))
                if (near == root).all():
                    break
                root = near
            out.append((here, ok @ copies[lo:hi][rows], root))
        join = lambda i: np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64)
        return pa.table({"id": pa.array(join(0)), "links": pa.array(join(1)), "root": pa.array(join(2))})

    packs = max(1, dealt.count() // TASK_ROWS)
    return (
        dealt.withColumn("pack", F.pmod(F.xxhash64("grp", "filter", "low", "high"), F.lit(packs)))
        .groupBy("pack")
        .applyInArrow(compare, "id long, links long, root long")
    )


def near(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept): one row for each row of ``table``."""
    start(table.sparkSession)
    kind = table.schema[key].dataType.simpleString()
    rows = table.select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label")
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where("id is not null and label is not null and vector is not null").where(
        fine & F.exists("vector", lambda x: x != 0)
    )
    grouped = valid.withColumn("grp", F.concat_ws(":", F.size("vector").cast("string"), "label"))
    classes = written(
        grouped.groupBy("grp", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    most = classes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    words = max(4, int(round((most * LISTED / CAP_ROWS) ** (1 / BLOCKS))))
    posts = written(filtered(classes, words), "caps")
    found = written(compared(posts), "capped")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    several = classes.where("copies > 1").select("grp", "vector", F.col("id").alias("leader"), "copies")
    members = written(
        grouped.join(several, ["grp", "vector"]).select("id", "leader", "copies"), "members"
    )
    together = components(
        found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(
            members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
        )
    )
    facts = (
        rows.select("id")
        .join(members.distinct(), "id", "left")
        .withColumn("leader", F.coalesce("leader", "id"))
        .join(links.select(F.col("id").alias("leader"), "links"), "leader", "left")
        .join(together.select(F.col("node").alias("id"), "component"), "id", "left")
    )
    return facts.select(
        F.col("id").cast(kind).alias(key),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").cast(kind).alias("component_id"),
        (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
