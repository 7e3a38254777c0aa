"""N-gram Jaccard join with PartEnum signatures, without loss.

Sets of 5-word shingles link at a Jaccard similarity of 3/4 or more. Sizes are put in bands, each
reaching as far as 4/3 of the one before, so linked sets are in the same or in neighbouring bands.
A set x differs from one it links with, y, in at most k = (|x| + |y|) / 7 elements. The domain of shingle
hashes is cut into n ranges; differing elements touch k of them at most, and any other range has
the same content in both. A signature names a subset of j ranges and their content. Ranges with shingles are put in
one order for all sets and each set enumerates the subsets of its first k + j: of the one whose
list ends first in that order, j ranges are untouched, so these are in the other's list as well, and the two sets
share a signature. Any order by content alone will do. Ranges that hold nothing but shingles that many texts of a
sample have come last, the most frequent ones at the very end, others fullest first: passages that many texts share
then make no candidates of texts that have enough besides, and what the sample misses costs time, but no link. n and j depend on the band: j is as large as the count of subsets allows, that is more than one
for small sets, whose ranges hold a shingle or two; larger sets' fullest ranges tell enough one by one. n is a
power of two, so most neighbouring bands share both and a set posts once for the two. n is chosen six standard deviations above
what k + j ranges need; the rare set that still has too few is compared with every set of its sizes, in blocks.

Equal sets are one class from the start: signatures are posted for names of sets, which become ids of leaders when all
have met; sets whose names clash are candidates. Runs of a signature up to
``RUN`` sets give all their pairs. Longer ones, named by their members so that equal runs are one, give the pairs with their smallest member, then, when
these are verified, with other members drawn in turn: members that are already together need no pair.
Those that are still apart after that are paired block by block. Parity sketches, whose differing bits never outnumber the differing
shingles, also when a longer one is folded to the length of a shorter one, throw out most pairs before any set is read; the remaining ones are verified exactly.

Cases: null, empty and blank texts have no shingles and link with nothing; texts of fewer than five
words have one; rows with a null key come back with a null component; rows that share a key are one
node and give a row each; texts are read whole; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import mix, raw, start, tidy, windows, word_hashes, written
from tidegate.llm.components import components
from tidegate.session import broadcast_if_small

WIDTH = 5
RUN = 16
BLOCK = 1024
PACK = 20_000  # rows of blocks that a task pairs at a time
PIVOTS = 4
ROUNDS = 2
MOST_RANGES = 1024  # for each shingle
SIGNATURES_PER_BUCKET = 1_500_000
NAME_BITS = 40  # of a set's first number that name it where sets meet
FLUSH = 1_000_000
RARE_BLOCK = 2_000_000  # shingles of rare sets that are broadcast at a time
SAMPLED, ONE_OF = 4_000, 32  # one text of so many is asked for frequent shingles, but so many texts at least
FREQUENT, MOST_FREQUENT = 3, 500_000  # from how many of these on a shingle is frequent; how many are kept


def upper(band: int) -> int:
    """Largest size of a band: 1, 2, 3, 4, 5, 6, 8, 10, 13, 17, ..."""
    size = 1
    for _ in range(band):
        size = max(size + 1, size * 4 // 3)
    return size


_UPPER = np.array([upper(b) for b in range(80)], dtype=np.int64)


def band_of(size: int) -> int:
    return int(np.searchsorted(_UPPER, size))


def differing(size: int, most: int) -> int:
    """In how many elements a set can differ from one of at most ``most`` elements that it links with."""
    return (size + min(most, 4 * size // 3)) // 7


@lru_cache(maxsize=None)
def cut(level: int) -> tuple[int, int]:
    """(n, j): into how many ranges the domain is cut for sets of a band, and how many make a subset."""
    most, least = int(_UPPER[level]), int(_UPPER[level - 1]) + 1 if level else 1
    k = differing(most, 2 * most)
    j = max(i for i in (1, 2, 3) if i == 1 or comb(k + i, i) <= most and k + i < least)
    n = 1
    while n < MOST_RANGES * most and not all(_enough(size, n, differing(size, 2 * size) + j) for size in (least, most)):
        n *= 2
    return n, j


def _needed(size: int, band: int, level: int) -> int:
    """From how many ranges a set enumerates subsets at a level."""
    reach = band + 1 if cut(band) == cut(band + 1) else level
    return differing(size, int(_UPPER[reach])) + cut(level)[1]


@lru_cache(maxsize=256)
def _subsets(count: int, j: int) -> np.ndarray:
    return np.array(list(combinations(range(count), j)), dtype=np.int64).reshape(-1, j)


def _enough(size: int, n: int, needed: int) -> bool:
    """Whether ``size`` shingles fall into ``needed`` of n ranges, but for six standard deviations."""
    if needed == 1:
        return True
    empty = exp(-size / n)
    return n - n * empty - 6 * sqrt(n * empty * (1 - (1 + size / n) * empty)) >= needed


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split() if text else []  # ASCII letters and white space only, as bytes do
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(WIDTH, len(words))
    return np.unique(mix(windows(word_hashes(words), width) + np.uint64(width)))


def _places(found: np.ndarray, n: int) -> np.ndarray:
    return ((found >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def rare(found: np.ndarray) -> bool:
    """Whether a set's shingles fall into too few ranges."""
    band = band_of(len(found))
    at = _places(found, cut(band)[0])
    return 1 + np.count_nonzero(at[1:] != at[:-1]) < _needed(len(found), band, band)


def _ranks(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """How frequent each shingle is, in powers of two; 0 for those that are not known to be."""
    if frequent is None or not len(frequent[0]):
        return np.zeros(len(found), dtype=np.uint8)
    names, ranks = frequent
    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
    return np.where(names[at] == found, ranks[at], 0)


def signatures(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Signatures of a set for its band and the next; ``frequent`` has to be the same for all sets."""
    size, band, out = len(found), band_of(len(found)), []
    ranks = _ranks(found, frequent)
    with np.errstate(over="ignore"):
        content = mix(found + np.uint64(0x51ED270B0A1F39C1))
        for level in (band,) if cut(band) == cut(band + 1) else (band, band + 1):
            n, j = cut(level)
            at = _places(found, n)
            first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
            each = mix(np.add.reduceat(content, first) + mix(at[first].astype(np.uint64) + np.uint64(n << 32 | j << 28)))
            held = np.diff(first, append=size)
            rank = np.minimum.reduceat(ranks, first)
            listed = each[np.lexsort((each, -held, rank))[: _needed(size, band, level)]]
            out.append(listed if j == 1 else mix(listed[_subsets(len(listed), j)].sum(axis=1, dtype=np.uint64)))
    return np.concatenate(out)


def name_of(found: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(found + np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (1, 2))


def sketch(found: np.ndarray) -> bytes:
    """One parity bit for each of twice to four times as many ranges as there are shingles: enough to
    tell sets that are somewhat less alike than the threshold from those that reach it."""
    n = max(64, 1 << (2 * len(found) - 1).bit_length())
    at = (mix(found) & np.uint64(n - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, length: int) -> int:
    """A sketch with ranges put together until it has ``length`` bytes; lengths are powers of two."""
    value = int.from_bytes(bits)
    for half in (len(bits) * 4 >> i for i in range((len(bits) // length).bit_length() - 1)):
        value = value >> half ^ value & (1 << half) - 1
    return value


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, h1, h2, rare, sketch): what is known of each row's set; h1, h2 name the set."""
    start(docs.sparkSession)

    def describe(batches):
        for batch in batches:
            rows = []
            for value in raw(batch, "text"):
                found = shingles(value)
                if not len(found):
                    rows.append((0, 0, 0, False, b""))
                    continue
                rows.append((len(found), *name_of(found), rare(found), sketch(found)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["id", "n_shingles", "h1", "h2", "rare", "sketch"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        describe, "id long, n_shingles long, h1 long, h2 long, rare boolean, sketch binary"
    )


def frequent_shingles(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and in how many, in powers of two. The sample
    only bears on the order of ranges; it is drawn by id and grows with the table."""
    one_of = max(1, min(ONE_OF, rows // SAMPLED))

    def cut_up(batches):
        for batch in batches:
            for value in raw(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(value).view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(one_of)) == 0).mapInArrow(tidy(cut_up), "shingle long")
    counts = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.floor(F.log2("n")), F.lit(60)).cast("int").alias("rank")
    counts = written(counts.where(F.col("n") >= FREQUENT).select("shingle", rank), "frequent")
    least, held = 61, 0
    for row in sorted(counts.groupBy("rank").count().collect(), key=lambda r: -r["rank"]):
        held += row["count"]
        if held > MOST_FREQUENT:
            break
        least = row["rank"]
    kept = counts.where(F.col("rank") >= least).toArrow()
    names = kept.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], kept.column("rank").to_numpy().astype(np.uint8)[order]


def _packed(numbers: np.ndarray) -> bytes:
    """The lowest 40 bits of each number."""
    return numbers.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    whole = np.zeros((len(packed) // 5, 8), dtype=np.uint8)
    whole[:, :5] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 5)
    return whole.view(np.uint64)[:, 0]


def posted(docs: DataFrame, buckets: int, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(bucket, names, sizes, sigs, counts): signatures of the distinct sets of each task, packed by bucket."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent)

    def post(batches):
        met, names, sizes_of, sigs = set(), [], [], []

        def out():
            if not names:
                return
            sizes = [len(s) for s in sigs]
            every, owner = np.concatenate(sigs), np.repeat(np.arange(len(names), dtype=np.uint16), sizes)
            bucket = ((every >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, owner = every[order], owner[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            name_array, size_array = np.array(names, dtype=np.int64), np.array(sizes_of, dtype=np.int32)
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if hi > lo:
                    there, counts = np.unique(owner[lo:hi], return_counts=True)  # signatures stand in their owners' order
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b], pa.int32()),
                            pa.array([_packed(name_array[there])], pa.binary()),
                            pa.array([size_array[there].tobytes()], pa.binary()),
                            pa.array([_packed(every[lo:hi])], pa.binary()),  # the bucket comes of the other bits
                            pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
                        ],
                        ["bucket", "names", "sizes", "sigs", "counts"],
                    )

        held = 0
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), raw(batch, "text"), strict=True):
                found = shingles(value)
                if i is None or not len(found):
                    continue
                name = name_of(found)
                if (*name, len(found)) in met:
                    continue
                met.add((*name, len(found)))
                names.append(name[0] & (1 << NAME_BITS) - 1)
                sizes_of.append(len(found))
                sigs.append(signatures(found, frequent.value))
                held += len(sigs[-1])
                if held >= FLUSH or len(names) == 1 << 16:
                    yield from out()
                    names, sizes_of, sigs, held = [], [], [], 0
        yield from out()

    return docs.mapInArrow(tidy(post), "bucket int, names binary, sizes binary, sigs binary, counts binary")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the columns, sorted alike, change."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def met(posts: DataFrame) -> DataFrame:
    """(sig, a, b), of names of sets: candidate pairs of short runs and of long runs' smallest members (sig null),
    and the members a of long runs (b null)."""

    def meet(table: pa.Table) -> pa.Table:  # long runs are named by their members; should two share a name, they are one
        ids, sizes, sigs, owners, known = [], [], [], [], 0
        for i, n, s, o in zip(*(table.column(c).to_pylist() for c in ("names", "sizes", "sigs", "counts")), strict=True):
            sizes.append(np.frombuffer(n, dtype=np.int32))
            ids.append(_unpacked(i) << np.uint64(24) | sizes[-1].astype(np.uint64) & np.uint64(0xFFFFFF))  # a name's sizes stay apart
            sigs.append(_unpacked(s))
            owners.append(np.repeat(np.arange(known, known + len(ids[-1])), np.frombuffer(o, dtype=np.uint32)))
            known += len(ids[-1])
        names, first, number = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        names, held = (names >> np.uint64(24)).view(np.int64), np.concatenate(sizes)[first].astype(np.int64)
        band = np.searchsorted(_UPPER, held)
        sig, doc = np.concatenate(sigs), number[np.concatenate(owners)]
        _, which, often = np.unique(sig, return_inverse=True, return_counts=True)
        shared = often[which] > 1
        sig, doc = np.tile(sig[shared], 2), np.tile(doc[shared], 2)
        level = band[doc]
        level[len(level) // 2 :] += 1  # sets of a band meet there and, as the smaller ones, in the next
        order = np.lexsort((doc, level, sig))
        sig, level, doc = sig[order], level[order], doc[order]
        fresh = _starts(sig, level, doc)
        sig, level, doc = sig[fresh], level[fresh], doc[fresh]
        run = np.cumsum(_starts(sig, level)) - 1
        top = np.zeros(len(run), dtype=bool)
        top[run[band[doc] == level]] = True
        sig, level, doc = sig[top[run]], level[top[run]], doc[top[run]]
        first = np.nonzero(_starts(sig, level))[0]
        size = np.diff(first, append=len(sig))
        place = np.arange(len(sig)) - np.repeat(first, size)
        size = np.repeat(size, size)
        pairs = [np.zeros(0, dtype=np.int64)]
        for step in range(1, RUN):  # members of short runs that are ``step`` apart
            at = np.nonzero((size <= RUN) & (place + step < size))[0]
            pairs.append(doc[at] * len(names) + doc[at + step])
        long = np.nonzero(size > RUN)[0]
        star = long[place[long] > 0]
        pairs.append(doc[star - place[star]] * len(names) + doc[star])
        pair = np.unique(np.concatenate(pairs))
        small, large = np.sort(np.stack([held[pair // len(names)], held[pair % len(names)]]), axis=0)
        pair = pair[4 * small >= 3 * large]
        if len(long):
            first = np.nonzero(place[long] == 0)[0]
            run = mix(np.add.reduceat(mix(names[doc[long]].view(np.uint64)), first))
            _, kept = np.unique(run, return_index=True)
            kept = np.isin(np.arange(len(run)), kept)
            each = np.diff(first, append=len(long))
            run, long = np.repeat(run[kept], each[kept]), long[np.repeat(kept, each)]
        else:
            run = np.zeros(0, dtype=np.uint64)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table(
            {
                "sig": pa.concat_arrays([none(len(pair)), pa.array(run.astype(np.int64))]),
                "a": pa.array(np.concatenate([names[pair // len(names)], names[doc[long]]])),
                "b": pa.concat_arrays([pa.array(names[pair % len(names)]), none(len(long))]),
            }
        )

    return posts.groupBy("bucket").applyInArrow(meet, "sig long, a long, b long")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _of(known: DataFrame, side: str) -> DataFrame:
    """What is known of each set, to be joined to ``side`` of pairs."""
    return known.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))


def likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that sizes and sketches leave possible."""
    for side in ("a", "b"):
        pairs = pairs.join(_of(known, side), side)
    near = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")

    def sift(batches):
        for batch in batches:
            na, nb, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            kept = [
                (folded(p, k := min(len(p), len(q))) ^ folded(q, k)).bit_count() <= (m + n) // 7
                for m, n, p, q in zip(na, nb, x, y, strict=True)
            ]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    columns = ["a", "b", "n_a", "n_b", "sketch_a", "sketch_b"]
    return pairs.where(near).select(*columns).mapInArrow(tidy(sift), "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _sets(docs: DataFrame) -> DataFrame:
    def build(batches):
        for batch in batches:
            found = [shingles(v).tobytes() for v in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "found"])

    return docs.mapInArrow(tidy(build), "id long, found binary")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by their whole sets; only texts in some pair are read into sets."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    ids, _ = broadcast_if_small(ids)  # a list of whole numbers of a checked size; beyond it, a shuffle
    found = written(_sets(docs.join(ids, "id", "left_semi")), "sets")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("found").alias(f"found_{side}")), side)

    def check(batches):
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("found_a", "found_b")}
            kept = [
                _alike(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                for x, y in zip(of["found_a"], of["found_b"], strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "found_a", "found_b").mapInArrow(tidy(check), "a long, b long")


def _open(runs: DataFrame, together: DataFrame) -> DataFrame:
    """Members (sig, a, component) of the long runs that are not one component yet."""
    members = runs.join(together.select(F.col("node").alias("a"), "component"), "a", "left").withColumn(
        "component", F.coalesce("component", "a")
    )
    several = members.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return written(members.join(several.where("low < high").select("sig"), "sig", "left_semi"), "open")


def pivoted(members: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each open run's members with one of them, the same one in many runs."""
    dice = F.xxhash64("a", F.pmod("sig", F.lit(PIVOTS)), F.lit(seed))
    pivots = members.groupBy("sig").agg(F.min_by(F.struct("a", "component"), dice).alias("pivot"))
    pairs = members.join(pivots, "sig").where(F.col("component") != F.col("pivot.component"))
    first, second = F.least("a", "pivot.a"), F.greatest("a", "pivot.a")
    return pairs.select(first.alias("a"), second.alias("b")).distinct()


def across(members: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of open runs' members that are not together yet and that sketches leave possible, by
    blocks of each run."""
    counts = members.groupBy("sig").agg(
        F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    rows = counts.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    dealt = (
        members.join(_of(known, "a"), "a")
        .withColumnsRenamed({"n_a": "n", "sketch_a": "sketch"})
        .join(counts, "sig")
        .withColumn("mine", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
        .drop("other", "blocks", "size")
    )

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("sig", "low", "high")])
        sig, low, high, mine, a, comp, n = (
            table.column(c).to_numpy() for c in ("sig", "low", "high", "mine", "a", "component", "n")
        )
        sketches = table.column("sketch").to_pylist()
        new = (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edges = [0, *(np.nonzero(new)[0] + 1).tolist(), len(sig)]
        found = set()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            length = min(len(x) for x in sketches[lo:hi])
            short = b"".join(folded(x, length).to_bytes(length) for x in sketches[lo:hi])
            bits, at = np.frombuffer(short, dtype=np.uint8).reshape(-1, length), np.arange(lo, hi)
            for k in range(len(at) - 1):
                x, y = at[k], at[k + 1 :]
                maybe = (comp[y] != comp[x]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
                if low[x] != high[x]:
                    maybe &= mine[y] != mine[x]
                maybe = np.nonzero(maybe)[0]
                if len(maybe):
                    ok = _differ(bits[k], bits[k + 1 :][maybe]) <= (n[x] + n[y[maybe]]) // 7
                    found.update((min(int(a[x]), int(a[z])), max(int(a[x]), int(a[z]))) for z in y[maybe[ok]])
        left, right = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return (
        dealt.withColumn("pack", F.pmod(F.xxhash64("sig", "low", "high"), F.lit(rows // PACK + 1)))
        .groupBy("pack")
        .applyInArrow(pair, "a long, b long")
        .distinct()
    )


def with_rare(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """Links of the sets that have too few ranges, with all sets of their sizes, block by block."""
    rare = known.where("rare").select("id", "n_shingles")
    total = rare.agg(F.sum("n_shingles")).first()[0]
    if not total:
        return None
    rare = rare.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(total // RARE_BLOCK + 1)))
    sets = written(_sets(docs.join(rare.select("id").distinct(), "id", "left_semi")), "rare")
    out = None
    for block in range(total // RARE_BLOCK + 1):
        here = sets.join(rare.where(F.col("block") == block).select("id").distinct(), "id", "left_semi").collect()
        shared = docs.sparkSession.sparkContext.broadcast(
            [(r["id"], np.frombuffer(r["found"], dtype=np.uint64)) for r in here if r["found"]]
        )

        def probe(batches, shared=shared):
            for batch in batches:
                links = []
                for i, value in zip(batch.column(0).to_pylist(), raw(batch, "text"), strict=True):
                    found = shingles(value)
                    for j, other in shared.value:
                        if i is not None and i != j and 4 * min(len(found), len(other)) >= 3 * max(len(found), len(other)):
                            if _alike(found, other):
                                links.append((j, i))
                a, b = zip(*links, strict=True) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        links = docs.mapInArrow(tidy(probe), "a long, b long")
        out = links if out is None else out.union(links)
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): one row for each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = written(profiles(docs, "id"), "profiles")
    sets = known.where("n_shingles > 0 and id is not null")
    names = ["h1", "h2", "n_shingles"]
    leaders = written(sets.groupBy(*names).agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("copies")), "leaders")
    copies = written(
        sets.join(leaders.where("copies > 1"), names).where("id <> leader").select("id", "leader").distinct(), "copies"
    )
    total, rows = known.agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    posts = posted(docs, max(8, (total or 0) // SIGNATURES_PER_BUCKET), frequent_shingles(docs, rows))
    found = written(met(posts), "met")

    named = leaders.select(F.col("h1").bitwiseAND(F.lit((1 << NAME_BITS) - 1)).alias("name"), "leader")

    def lead(df: DataFrame, side: str) -> DataFrame:
        to = named.withColumnRenamed("name", side)
        return df.join(to, side).withColumn(side, F.col("leader")).drop("leader")

    # A pair can come from several buckets that its sets share.
    pairs = lead(lead(found.where("b is not null").select("a", "b").distinct(), "a"), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    # Sets that share a name have not met.
    clashes = named.groupBy("name").agg(F.collect_set("leader").alias("all")).where("size(all) > 1")
    clashes = clashes.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    pairs = pairs.union(clashes)
    links = written(verified(likely(pairs, sets), docs), "links")
    runs = written(lead(found.where("b is null").select("sig", "a"), "a").distinct(), "runs")
    members = _open(runs, components(links))
    for seed in range(ROUNDS):
        links = written(links.union(verified(likely(pivoted(members, seed), sets), docs)), "links")
        members = _open(runs, components(links))
    more = verified(across(members, sets), docs)
    links = links.union(more).union(copies.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    if (rare := with_rare(docs, sets)) is not None:
        links = links.union(rare)
    together = components(links)
    return (
        known.select("id", "n_shingles")
        .join(together, F.col("id") == F.col("node"), "left")
        .select(F.col("id").cast(kind).alias(key), "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id"))
    )


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but those whose group has a smaller key; rows with a null key stay."""
    gone = join(docs, key, text).where(F.col("component_id") < F.col(key)).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)
