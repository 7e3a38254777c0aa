"""Substring dedup by relative Lempel-Ziv parsing against reference blocks of the corpus.

Documents are dealt into reference blocks by their keys, and every block's windows of ``WINDOW``
words are indexed with the smallest document that each starts in. A document is parsed greedily from
left to right: the longest stretch from here on whose windows all start in one earlier document is a
factor, and a word where nothing starts is a literal. Factors are at least a window long, so each is a
duplicate span; where one ends, the window at the boundary is looked up anew, so a passage that goes
on in another document opens the next factor at once and no window across a boundary is lost.

To index only what can repeat, each window is represented by an anchor, the least of its hashed
10-word phrases. Equal windows have equal anchors, so a window can only repeat if its anchor is met
in two documents; only windows with such anchors are posted. Blocks post an anchor and a window once,
however often they hold it, so a passage in a third of all documents is a row for each block.

Cases: null, empty and blank texts have no words and nothing removed, and so have texts shorter than
a window; rows that share a key are one document, whose windows do not remove each other; rows with a
null key keep all their words and are no reference; texts are read whole; other columns are not
read; empty tables give no rows. Windows are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import start, tidy, windows, word_hashes, written

WINDOW = 50
PHRASE = 10
BLOCK_BYTES = 5_000_000  # text in a reference block
ENTRIES_PER_PART = 2_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []  # ASCII white space only, as bytes do


def anchors(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> np.ndarray:
    """For each window, the least mixed hash of its phrases: minima of sliding ranges by doubling."""
    low = windows(hashes, phrase)
    need, span = window - phrase + 1, 1
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = need - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


class Block:
    """A reference block's documents and where their windows start; words are held one text at a time."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        # Documents in order of their keys, those without one last.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.rows = order
        self.ids = np.array([ids[i] if ids[i] is not None else np.iinfo(np.int64).max for i in order], dtype=np.int64)
        prints, mins, docs, starts = [], [], [], []
        for n, i in enumerate(order):
            words = words_of(texts[i]) if ids[i] is not None else []
            if len(words) >= WINDOW:
                hashed = word_hashes(words)
                prints.append(windows(hashed, WINDOW))
                mins.append(anchors(hashed))
                docs.append(np.full(len(prints[-1]), n))
                starts.append(np.arange(len(prints[-1])))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.prints, self.anchors = join(prints, np.uint64), join(mins, np.uint64)
        self.docs, self.starts = join(docs, np.int64), join(starts, np.int64)

    def anchor_posts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether two documents of the block have them."""
        order = np.argsort(self.anchors, kind="stable")
        anchor, doc = self.anchors[order], self.ids[self.docs[order]]
        kinds, first = np.unique(anchor, return_index=True)
        if not len(kinds):
            return kinds, np.zeros(0, dtype=bool)
        return kinds, np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)

    def window_posts(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows with a live anchor, and the smallest document that each starts in."""
        here = np.isin(self.anchors, live)
        prints, docs = self.prints[here], self.docs[here]
        kinds, first = np.unique(prints, return_index=True)  # documents are in order of their keys
        return kinds, self.ids[docs[first]]

    def earlier(self, prints: np.ndarray, source: np.ndarray) -> np.ndarray:
        """For each window the smallest document it starts in, if that is before its own; else -1 as
        a mark (any key may be negative, so the mark is the window's own document)."""
        own = self.ids[self.docs]
        kinds, first, inverse = np.unique(self.prints, return_index=True, return_inverse=True)
        least = own[first] if len(kinds) else own
        if len(prints) and len(kinds):
            at = np.minimum(np.searchsorted(kinds, prints), len(kinds) - 1)
            ok = kinds[at] == prints
            np.minimum.at(least, at[ok], source[ok])
        return least[inverse] if len(kinds) else own

    def factors(self, least: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, end, reference) of each document's factors, by the greedy parse."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.rows]
        hit = least < self.ids[self.docs]
        at = np.nonzero(hit)[0]
        if not len(at):
            return out
        # A factor ends where the next window does not follow, is of another document or has another reference.
        cut = np.nonzero(
            (np.diff(at) != 1) | (self.docs[at[1:]] != self.docs[at[:-1]]) | (least[at[1:]] != least[at[:-1]])
        )[0]
        for lo, hi in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(at) - 1], strict=True):
            a, b = at[lo], at[hi]
            out[self.docs[a]].append((int(self.starts[a]), int(self.starts[b]) + WINDOW, int(least[a])))
        return out


def _block(table: pa.Table) -> Block:
    ids = table.column("id").to_pylist()
    texts = table.column("text").cast(pa.binary()).to_pylist()
    return Block(ids, texts)


def _longs(table: pa.Table, name: str, kind=np.uint64) -> np.ndarray:
    parts = [np.frombuffer(v, dtype=kind) for v in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _parted(part_count: int, block: int, order_by: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each part of the index that the block posts to."""
    part = ((order_by >> np.uint64(32)) * np.uint64(part_count) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(part_count + 1))  # entries come sorted
    there = np.nonzero(np.diff(edges))[0]
    return pa.table(
        {
            "part": pa.array(there, pa.int32()),
            "block": pa.array(np.full(len(there), block), pa.int32()),
            **{
                name: pa.array([values[edges[p] : edges[p + 1]].tobytes() for p in there], pa.binary())
                for name, values in columns.items()
            },
        }
    )


def spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(key, text, spans array<struct<start, end, reference>>) of each row: its factors, in words.
    ``carry`` names a column that is to come along."""
    start(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    load = docs.schema[carry].dataType if carry else T.BooleanType()
    docs = docs.select(
        F.col(key).cast("long").alias("id"),
        F.col(text).alias("text"),
        (F.col(carry) if carry else F.lit(None).cast("boolean")).alias("carried"),
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes + 1)
    parts = int(size // 6 // 20 * 2 // ENTRIES_PER_PART + 4)
    # Rows without a key are spread by their text.
    number = F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.xxhash64("text"))), F.lit(blocks)).cast("int")
    whole = docs.withColumn("block", number)
    dealt = whole.drop("carried")

    def post_anchors(table: pa.Table) -> pa.Table:
        kinds, several = _block(table).anchor_posts()
        return _parted(parts, table.column("block")[0].as_py(), kinds, {"anchor": kinds, "several": several})

    def meet_anchors(table: pa.Table) -> pa.Table:
        """Back to each block: its anchors that some two documents have."""
        anchor, several = _longs(table, "anchor"), _longs(table, "several", np.bool_)
        kinds, inverse, n = np.unique(anchor, return_inverse=True, return_counts=True)
        live = (n > 1) | (np.bincount(inverse, weights=several, minlength=len(kinds)) > 0)
        back, lo = [], 0
        for value in table.column("anchor").to_pylist():
            hi = lo + len(value) // 8
            back.append(anchor[lo:hi][live[inverse[lo:hi]]].tobytes())
            lo = hi
        return pa.table({"block": table.column("block"), "live": pa.array(back, pa.binary())})

    def post_windows(table: pa.Table, live: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _parted(parts, 0, np.zeros(0, np.uint64), {"print": np.zeros(0, np.uint64), "least": np.zeros(0, np.int64)})
        kinds, least = _block(table).window_posts(_longs(live, "live"))
        return _parted(parts, table.column("block")[0].as_py(), kinds, {"print": kinds, "least": least})

    def meet_windows(table: pa.Table) -> pa.Table:
        """Back to each block: its windows that start in a smaller document of another block."""
        prints, least = _longs(table, "print"), _longs(table, "least", np.int64)
        kinds, inverse = np.unique(prints, return_inverse=True)
        first = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse, least)
        source = first[inverse]
        back, lo = [], 0
        for value in table.column("print").to_pylist():
            hi = lo + len(value) // 8
            less = source[lo:hi] < least[lo:hi]
            back.append((prints[lo:hi][less].tobytes(), source[lo:hi][less].tobytes()))
            lo = hi
        return pa.table(
            {
                "block": table.column("block"),
                "print": pa.array([p for p, _ in back], pa.binary()),
                "source": pa.array([s for _, s in back], pa.binary()),
            }
        )

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reference", pa.int64())]))

    def parse(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows:
            none = table.select(["id", "text", "carried"])
            return none.append_column("spans", pa.array([], span))
        block = _block(table)
        found = block.factors(block.earlier(_longs(hits, "print"), _longs(hits, "source", np.int64)))
        of = dict(zip(block.rows, found, strict=True))
        lists = [[{"start": s, "end": e, "reference": r} for s, e, r in of[i]] for i in range(table.num_rows)]
        return table.select(["id", "text", "carried"]).append_column("spans", pa.array(lists, span))

    posted = dealt.groupBy("block").applyInArrow(post_anchors, "part int, block int, anchor binary, several binary")
    live = written(posted.groupBy("part").applyInArrow(meet_anchors, "block int, live binary"), "anchors")
    entries = (
        dealt.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(post_windows, "part int, block int, print binary, least binary")
    )
    hits = written(entries.groupBy("part").applyInArrow(meet_windows, "block int, print binary, source binary"), "windows")
    factor = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "reference")])
    out = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("carried", load),
            T.StructField("spans", T.ArrayType(factor)),
        ]
    )
    found = (
        whole.groupBy("block")
        .cogroup(hits.groupBy("block"))
        .applyInArrow(parse, out)
    )
    return found.select(
        F.col("id").cast(kind).alias(key),
        F.col("text").alias(text),
        *([F.col("carried").alias(carry)] if carry else []),
        "spans",
    )


def keep(words: list[bytes], found: list[dict]) -> list[bytes]:
    """The words outside of all spans, which come in order of their starts."""
    kept, at = [], 0
    for one in found:
        kept.extend(words[at : one["start"]])
        at = max(at, one["end"])
    kept.extend(words[at:])
    return kept


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            n, removed, sha = [], [], []
            for value, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(value)
                kept = keep(words, found)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["key", "n_words", "n_removed", "kept_sha256"],
            )

    found = spans(docs, key, text).select(F.col(key).alias("key"), F.col(text).alias("text"), "spans")
    return found.mapInArrow(tidy(digest), f"key {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("key", key)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with the kept words of each text, joined by single blanks, where some are removed, and
    with ``size``, if there is such a column, set to the new length. Other texts stay as they are."""
    kind = docs.schema[size].dataType.simpleString() if size in docs.columns else None
    # The other columns ride along with the text as one value.
    rest = [c for c in docs.columns if c != text]
    carried = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*rest).alias("_row"))
    found = spans(carried, "_key", "_text", carry="_row")

    def cut(batches):
        for batch in batches:
            out = []
            for value, spots in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out.append(b" ".join(keep(words_of(value), spots)) if spots else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["_row", "_text", "_kept"]
            )

    row = T.StructType(
        [carried.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_kept", T.BinaryType())]
    )
    done = found.select("_row", "_text", "spans").mapInArrow(tidy(cut), row)
    kept = F.col("_kept").cast("string")
    columns = []
    for name in docs.columns:
        if name == text:
            column = F.coalesce(kept, "_text")
        else:
            column = F.col("_row").getField(name)
            if name == size:
                column = F.when(kept.isNotNull(), F.length(kept).cast(kind)).otherwise(column)
        columns.append(column.alias(name))
    return done.select(*columns)
