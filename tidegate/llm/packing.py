"""Best-fit packing of token pieces into sequences by a configuration linear program.

Lengths are bounded by the capacity, so the histogram of lengths is small however many pieces there
are. On it, the covering program "fewest bins, each filled by one configuration, every length covered
as often as it occurs" is solved by multiplicative weights: each round prices the lengths by their
weights, finds the dearest configurations by a knapsack dynamic program, gives them a share of the
bins and lowers the weights of the lengths they cover. The fractional solution is rounded down,
and best fit places the rest, whose number depends on the number of configurations, not on the table:
the longest piece left takes the pieces that come nearest to filling its bin.

A plan is a list of runs: the pieces of one length with ranks from ``first`` on go to bins from
``sequence`` on, ``per_bin`` to each. Ranks come from a window over (length, bucket), with buckets of
a bounded number of rows, so a length that a third of all pieces share is never in one task.

Cases: null text counts as empty, and an empty text is the end token alone; texts longer than the
capacity are cut, the first piece taking what is left over; repeated rows and ids are packed one by
one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import raw, start, text_of, tidy, written
from tidegate.llm.tokens import Encoder

CAPACITY = 1024
END_ID = 2
ROUNDS = 200
STEP = 0.7
BUCKET_ROWS = 100_000
MOST_RUNS = 1_000_000

Bin = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dearest filling of every room up to ``capacity``, and the size to put in first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            values = prices[:k] + best[room - sizes[:k]]
            j = k - 1 - int(values[::-1].argmax())  # of equals the longest, to keep short pieces for later
            if values[j] >= best[room]:
                best[room], take[room] = values[j], sizes[j]
    return best, take


def _filled(first: int, take: np.ndarray, capacity: int, counts: np.ndarray) -> Bin:
    """The bin that starts with ``first`` and goes on as priced, with no length used more often than it occurs."""
    used, room = {first: 1}, capacity - first
    while room > 0:
        size = int(take[room])
        if not size:
            room -= 1
            continue
        room -= size
        if used.get(size, 0) < counts[size]:
            used[size] = used.get(size, 0) + 1
    return tuple(sorted(used.items(), reverse=True))


def fractional(counts: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> dict[Bin, float]:
    """How often to use each configuration, by multiplicative weights; covers about all of ``counts``."""
    capacity = len(counts) - 1
    sizes = np.nonzero(counts)[0]
    if not len(sizes):
        return {}
    needed = counts[sizes].astype(float)
    total = max(float((sizes * needed).sum()) / capacity, needed[sizes * 2 > capacity].sum())
    log_weight = np.log(needed * sizes)
    at = np.zeros(capacity + 1, dtype=np.int64)
    at[sizes] = np.arange(len(sizes))
    shares: dict[Bin, float] = {}
    covered = np.zeros(len(sizes))
    for _ in range(rounds):
        prices = np.exp(log_weight - log_weight.max()) / needed
        best, take = knapsack(sizes, prices, capacity)
        value = prices + best[capacity - sizes]
        near = np.nonzero(value >= (1 - 0.01) * value.max())[0]
        bins = {_filled(int(sizes[j]), take, capacity, counts) for j in near}
        share = total / rounds / len(bins)
        gained = np.zeros(len(sizes))
        for one in bins:
            shares[one] = shares.get(one, 0.0) + share
            for size, k in one:
                gained[at[size]] += share * k
        covered += gained
        log_weight -= step * gained / needed
    # No configuration is used beyond what its lengths need on average.
    over = np.ones(capacity + 1)
    over[sizes] = np.maximum(covered / needed, 1e-9)
    return {one: x / max(1.0, max(over[s] for s, _ in one)) for one, x in shares.items()}


def _two(room: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One or two pieces that fill ``room`` exactly, the longer one as long as can be."""
    if left[room] > 0:
        return (room,)
    longer = np.arange(room - 1, (room - 1) // 2, -1)
    ok = (left[longer] > 0) & (left[room - longer] > 0) & ((longer * 2 != room) | (left[longer] > 1))
    return (int(longer[ok.argmax()]), room - int(longer[ok.argmax()])) if len(longer) and ok.any() else None


def _fullest(room: int, left: np.ndarray) -> tuple[int, ...]:
    """Pieces whose sum comes as near to ``room`` as any choice of those left: few and long ones where
    two or three do, else by the sums that can be reached at all, kept as bits."""
    if room == 0:
        return ()
    if found := _two(room, left):
        return found
    fitting = np.nonzero(left[: room + 1])[0][::-1].tolist()
    for size in fitting[:48]:
        left[size] -= 1
        found = _two(room - size, left) if size < room else None
        left[size] += 1
        if found:
            return (size, *found)
    reached, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in fitting:
        for _ in range(min(int(left[size]), room // size)):
            steps.append((size, reached))
            wider = (reached | reached << size) & mask
            if wider == reached:
                break
            reached = wider
    at, chosen = reached.bit_length() - 1, []
    for size, earlier in reversed(steps):
        if not earlier >> at & 1:
            chosen.append(size)
            at -= size
    return tuple(chosen)


def best_fit(counts: np.ndarray) -> dict[Bin, int]:
    """Longest piece first, each bin filled up with what fits it best, as often as that lasts."""
    left, capacity, found = counts.copy(), len(counts) - 1, {}
    for size in range(capacity, 0, -1):
        while left[size] > 0:
            left[size] -= 1
            kinds, n = np.unique([size, *_fullest(capacity - size, left)], return_counts=True)
            left[size] += 1
            times = int((left[kinds] // n).min())
            left[kinds] -= times * n
            one = tuple(zip(kinds[::-1].tolist(), n[::-1].tolist(), strict=True))
            found[one] = found.get(one, 0) + times
    return found


def _least_fill(counts: np.ndarray) -> int:
    """The mean fill of the fewest bins that any packing needs; fuller configurations lose nothing."""
    sizes, capacity = np.arange(len(counts)), len(counts) - 1
    held = int((sizes * counts).sum())
    least = max(-(-held // capacity), int(counts[capacity // 2 + 1 :].sum()), 1)
    return -(-held // least)


def solve(counts: np.ndarray, repeats: int = 1) -> dict[Bin, int]:
    """Whole bins that hold ``counts[length]`` pieces of each length exactly."""
    left, bins = counts.astype(np.int64).copy(), {}
    capacity = len(counts) - 1

    def use(one: Bin, most: int) -> int:
        times = min([most, *(int(left[s]) // k for s, k in one)])
        if times > 0:
            bins[one] = bins.get(one, 0) + times
            for s, k in one:
                left[s] -= times * k
        return max(times, 0)

    use(((capacity, 1),), int(left[capacity]))
    for _ in range(repeats):
        shares = sorted(fractional(left).items(), key=lambda x: (-x[1], x[0]))
        full = _least_fill(left)
        used = sum(use(one, int(x)) for one, x in shares if sum(s * k for s, k in one) >= full)
        if not used:
            break
    for one, n in best_fit(left).items():
        bins[one] = bins.get(one, 0) + n
    return bins


def runs(bins: dict[Bin, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, per_bin, sequence, offset) of the plan; ranks count from 0."""
    out, sequence, seen = [], 0, {}
    for one, times in sorted(bins.items(), reverse=True):
        offset = 0
        for size, k in one:
            first = seen.get(size, 0)
            seen[size] = first + times * k
            out.append((size, first, first + times * k - 1, k, sequence, offset))
            offset += size * k
        sequence += times
    return out


def pieces(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(key, piece, start, length, ids binary): whole texts as ids and the end token, cut at the capacity."""
    start(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encoder = Encoder.plain(path)
        for batch in batches:
            row, begin, ids = [], [], []
            for i, coded in enumerate(encoder.encode([text_of(v) for v in raw(batch, "text")])):
                coded += end
                n = len(coded) // 4
                at, size = 0, (n - 1) % capacity + 1
                while at < n:
                    row.append(i)
                    begin.append(at)
                    ids.append(coded[4 * at : 4 * (at + size)])
                    at, size = at + size, capacity
            rows = pa.array(row, pa.int64())
            first = np.array(begin) == 0
            number = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if row else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array(number, pa.int32()),
                    pa.array(begin, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["key", "piece", "start", "length", "ids"],
            )

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(tidy(cut), f"key {kind}, piece int, start long, length long, ids binary")
        .withColumnRenamed("key", key)
    )


def pack(items: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``items`` (key, piece, length up to the capacity, ...) with sequence_id and offset.

    ``items`` is read three times: give a written table where it is costly.
    """
    spark = items.sparkSession
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in items.groupBy("length").count().collect():  # at most one row per length
        histogram[row["length"]] = row["count"]
    plan = runs(solve(histogram))
    if len(plan) > MOST_RUNS:
        raise ValueError(f"{len(plan)} runs in the packing plan; at most {MOST_RUNS} are broadcast")
    buckets = max(1, -(-int(histogram.sum()) // bucket_rows))
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    ranked = (
        dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece")))
        .join(before, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    )
    table = spark.createDataFrame(
        plan, "_length long, _first long, _last long, _per_bin long, _sequence long, _offset long"
    )
    nth = F.col("_rank") - F.col("_first")
    return (
        ranked.join(
            F.broadcast(table), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
        )
        .withColumn("sequence_id", F.col("_sequence") + F.expr("(_rank - _first) div _per_bin"))
        .withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_per_bin")) * F.col("length"))
        .select(*items.columns, "sequence_id", "offset")
    )


def packed_digests(docs: DataFrame, path: str) -> DataFrame:
    """Every piece of every document with its place and the checksum of its ids."""
    cut = pieces(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(cut, "pieces"))
