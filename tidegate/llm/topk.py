"""Exact top-k inner products by MaxScore over shards of quantised vectors.

A component is a term; its posting for a vector is the quantised value. Per query and shard each term
has a bound, the largest positive part it can add to any score of the shard. Terms are sorted by bound;
those whose bounds together stay below the k-th best score so far are non-essential: a vector
that has nothing positive in the essential terms cannot compete. Essential postings are traversed, the
dearest first, then the others are probed, and a vector is dropped as soon as what it has plus the
bounds still to come is below the k-th best score. Scores are whole numbers, summed in doubles where no
sum can reach 2^53, in 64-bit integers where none can reach 2^62 and in Python's integers beyond, so they are exact.

Vectors are packed into shards and queries into blocks, and each block meets every shard once: the
stated query set against all rows. A task goes through the shards of a block in turn, carries the k-th
best scores from one to the next and sends at most k rows a query; these are merged per query.

Cases: null vectors, and vectors with null or non-finite components, take no part, and neither do rows
with a null id; vectors of other lengths count as filled up with zeros; ties go to the smaller id; a
query with fewer than k candidates gets them all; rows that repeat an id are candidates one by one,
but never for a query of that id, and queries that repeat an id and a vector count once; other columns are not
read; empty tables give no rows. A component whose scale * x is no finite double counts as non-finite. Scores
beyond a long are given as the nearest long; ranks go by the exact ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import start, written

SHARD_ROWS = 4_096
BLOCK_QUERIES = 1_024
SHARDS_PER_TASK = 8
SCALE = 256
STEP = 8  # terms that are added between two looks at the bounds
LONG = 1 << 63

_whole = np.frompyfunc(int, 1, 1)


def quantised(vectors: list, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers floor(scale * x) of the vectors that take part, and which these are."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out, kept = np.zeros((len(vectors), width)), np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v is not None and None not in v:
            out[i, : len(v)] = v
            kept[i] = np.isfinite(out[i]).all()
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.floor(out * scale)
    kept &= np.isfinite(out).all(axis=1)
    return out[kept], kept


class Shard:
    """Postings of one shard, a row of ``terms`` for each component, and what bounds them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.top = abs(vectors).max(0) if len(ids) else np.zeros(vectors.shape[1])
        self._forms = {np.float64: self._bounded(np.ascontiguousarray(vectors[order].T))}

    @staticmethod
    def _bounded(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if terms.shape[1] == 0:
            return terms, terms.sum(1), terms.sum(1)
        return terms, terms.max(1), terms.min(1)

    def form(self, query: np.ndarray) -> type:
        """The narrowest numbers in which no sum of this query's products can lose a digit."""
        width = min(len(query), len(self.top))
        with np.errstate(over="ignore", invalid="ignore"):
            reach = 2 * (abs(query[:width]) * self.top[:width]).sum()
        most = max(abs(query).max(initial=0), self.top.max(initial=0))
        if reach < 1 << 52:
            return np.float64
        return np.int64 if reach < 1 << 61 and most < 1 << 61 else object

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """(-score, id) of the shard's vectors that may be among the k best, of all that reach ``least``."""
        kind = self.form(query)
        if kind not in self._forms:
            wide = self._forms[np.float64][0]
            self._forms[kind] = self._bounded(_whole(wide) if kind is object else wide.astype(kind))
        terms, high, low = self._forms[kind]
        width = min(len(query), len(terms))
        q = query[:width] if kind is np.float64 else _whole(query[:width]).astype(kind)
        high, low = high[:width], low[:width]
        bound = np.maximum(np.maximum(q * high, q * low), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, dtype=kind)])  # bounds from a place on
        if least is not None and rest[0] < least:
            return []
        # Rows of the query's own id are no candidates, so they may not lift the k-th best score.
        lo, hi = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        # Non-essential terms: the last ones whose bounds together stay below the k-th best score.
        known = 1 if least is None else max(least, 1)
        essential = max(int((rest[:-1] >= known).sum()), 1) if width else 0
        places = np.concatenate([np.arange(lo), np.arange(hi, len(self.ids))])
        alive, score = None, np.zeros(len(self.ids), dtype=kind)
        at = 0
        while at < width:
            some = order[at : min(at + STEP, width)]
            score = score + q[some] @ (terms[some] if alive is None else terms[some][:, alive])
            at += len(some)
            if alive is not None or at >= essential or least is not None and rest[at] < least:
                if alive is None:
                    alive, score = places, score[places]
                if least is None and at >= width // 2 and len(score) > k:
                    tail = order[at:]
                    worst = np.minimum(q[tail] * high[tail], q[tail] * low[tail]).sum()
                    least = int(np.sort(score + worst)[len(score) - k])
                if least is not None:
                    keep = (score + rest[at] >= least).astype(bool)
                    alive, score = alive[keep], score[keep]
        if alive is None:
            alive, score = places, score[places]
        best = np.argsort(-score, kind="stable")[:k]  # ids stand in their order
        return [(-int(s), int(v)) for s, v in zip(score[best], self.ids[alive[best]], strict=True)]


def _over(score: int) -> bytes:
    """Bytes that order scores which share their nearest long."""
    if -LONG <= score < LONG:
        return b"\x80"
    size = (abs(score).bit_length() + 7) // 8
    held = size.to_bytes(4) + abs(score).to_bytes(size)
    return b"\xff" + held if score > 0 else b"\x00" + bytes(255 - b for b in held)


def narrow(vectors: np.ndarray) -> np.ndarray:
    """In 32 bits where all components fit."""
    return vectors.astype(np.int32) if abs(vectors).max(initial=0) < 1 << 31 else vectors


def packed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """(name, ids, width, vectors): rows (id, vector) dealt by id into packs of about ``size``."""
    count = rows.count()
    packs = max(1, -(-count // size))

    def pack(table: pa.Table) -> pa.Table:
        vectors, kept = quantised(table.column("vector").to_pylist())
        ids = table.column("id").to_numpy()[kept]
        return pa.table(
            {
                name: table.column("pack")[:1],
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "width": pa.array([vectors.shape[1]], pa.int32()),
                "vectors": pa.array([narrow(vectors).tobytes()], pa.binary()),
            }
        )

    dealt = rows.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int"))
    return dealt.groupBy("pack").applyInArrow(pack, f"{name} int, ids binary, width int, vectors binary")


def _unpacked(ids: bytes, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype=np.int64)
    kind = np.int32 if len(vectors) == 4 * len(ids) * width else np.float64
    return ids, np.frombuffer(vectors, dtype=kind).reshape(len(ids), width).astype(np.float64)


def search(
    table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of every row for which ``is_query`` holds."""
    start(table.sparkSession)
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    shards = written(packed(rows.drop("asks"), "shard", SHARD_ROWS), "shards")
    queries = written(packed(rows.where("asks").drop("asks").distinct(), "block", BLOCK_QUERIES), "queries")
    blocks = queries.agg(F.max("block")).first()[0]
    blocks = 0 if blocks is None else blocks + 1
    # Every block with every shard, by the number of the block.
    grid = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))))).join(
        queries.select("block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "width", "vectors"))), "block"
    )
    tasks = max(1, blocks * -(-shards.count() // SHARDS_PER_TASK))
    dealt = grid.repartition(tasks, "block", (F.col("shard") / SHARDS_PER_TASK).cast("int")).sortWithinPartitions("block", "shard")

    def run(batches):
        now, queries, best = None, None, None

        def out():
            if now is not None:
                rows = [(int(queries[0][i]), v, -s) for i, found in enumerate(best) for s, v in found]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [
                    [q for q, _, _ in rows],
                    [v for _, v, _ in rows],
                    [min(max(s, -LONG), LONG - 1) for _, _, s in rows],
                    [_over(s) for _, _, s in rows],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score", "over"]
                )

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    yield from out()
                    now = row["block"]
                    queries = _unpacked(row["q_ids"], row["q_width"], row["q_vectors"])
                    best = [[] for _ in queries[0]]
                shard = Shard(*_unpacked(row["ids"], row["width"], row["vectors"]))
                for i, (own, query) in enumerate(zip(*queries, strict=True)):
                    least = -best[i][k - 1][0] if len(best[i]) >= k else None
                    best[i] = sorted(best[i] + shard.search(query, own, k, least))[:k]
        yield from out()

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id"))
    return (
        dealt.mapInArrow(run, "query_id long, vec_id long, score long, over binary")
        .withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
