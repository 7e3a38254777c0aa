"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' most frequent pieces are compiled into an automaton that shares prefixes and suffixes.
Each state knows how many words pass its earlier edges, so the sum along a path is the word's number,
and the number leads to the word's ids: a transducer in flat arrays, mapped into memory by the
workers and walked for all words of a batch at once. Words it lacks are merged exactly.

Cases: null text counts as empty (no ids); repeated rows and ids give a row each; ill-formed UTF-8
is read with U+FFFD; the vocabulary's special tokens inside a text become their ids, as the library
does; only the key and the text are read, so other columns may have any name. An empty table gives
no rows, and a lexicon without words leaves everything to the merges.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import raw, start, text_of
from tidegate.llm.tokens import Encoder, Vocabulary

LEXICON_WORDS = 60_000
COUNT_WINDOW = 4_000_000


class Lexicon:
    """Arrays of the transducer: edges by (state, byte), counts before each edge, ids by number."""

    FIELDS = (("edges", "<i8"), ("targets", "<i4"), ("before", "<i4"), ("final", "<i1"), ("at", "<i8"), ("ids", "<u4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: dict[bytes, bytes]) -> Lexicon:
        """Words with their ids. Words are added in sorted order; a state whose words are all in is
        replaced by an equal one if there is one."""
        order = sorted(words)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (parent, byte) of the states still open, root first

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, byte = path.pop()
                child = edges[parent][byte]
                same = register.setdefault((final[child], *edges[child].items()), child)
                if same != child:
                    edges[parent][byte] = same
                    if child == len(edges) - 1:
                        edges.pop(), final.pop()

        last = b""
        for word in order:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(shared)
            state = edges[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[shared:]:
                edges.append({})
                final.append(False)
                edges[state][byte] = len(edges) - 1
                path.append((state, byte))
                state = len(edges) - 1
            final[state] = True
            last = word
        settle(0)

        below: dict[int, int] = {}

        def count(root: int) -> int:
            stack = [root]
            while stack:
                state = stack[-1]
                todo = [t for t in edges[state].values() if t not in below]
                if todo:
                    stack.extend(todo)
                else:
                    below[stack.pop()] = final[state] + sum(below[t] for t in edges[state].values())
            return below[root]

        count(0)
        keys, targets, before = [], [], []
        for state in sorted(below):
            passed = int(final[state])
            for byte in sorted(edges[state]):
                keys.append(state * 256 + byte)
                targets.append(edges[state][byte])
                before.append(passed)
                passed += below[edges[state][byte]]
        sizes = [len(words[w]) // 4 for w in order]
        return cls(
            {
                "edges": np.array(keys, dtype="<i8"),
                "targets": np.array(targets, dtype="<i4"),
                "before": np.array(before, dtype="<i4"),
                "final": np.array(final, dtype="<i1"),
                "at": np.concatenate([[0], np.cumsum(sizes, dtype="<i8")]).astype("<i8"),
                "ids": np.frombuffer(b"".join(words[w] for w in order), dtype="<u4"),
            }
        )

    def dump(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        return np.array([len(a) for a in arrays], dtype="<i8").tobytes() + b"".join(
            a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays
        )

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The arrays over a memory-mapped scratch file of this worker that has no name."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, arrays = np.frombuffer(view, dtype="<i8", count=len(cls.FIELDS)), 8 * len(cls.FIELDS), {}
        for (name, kind), size in zip(cls.FIELDS, sizes, strict=True):
            arrays[name] = np.frombuffer(view, dtype=kind, count=int(size), offset=at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in sorted order, -1 if it is not in. All words take a step together."""
        state = np.zeros(len(words), dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else lengths
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        alive = np.nonzero(lengths)[0] if len(self.edges) else np.zeros(0, dtype=np.int64)
        state[lengths == 0] = 0
        if not len(self.edges):
            state[:] = -1
        step = 0
        while len(alive):
            key = state[alive] * 256 + flat[starts[alive] + step]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            state[alive[~hit]] = -1
            alive, edge = alive[hit], edge[hit]
            state[alive] = self.targets[edge]
            number[alive] += self.before[edge]
            step += 1
            alive = alive[lengths[alive] > step]
        known = state >= 0
        known[known] = self.final[state[known]] > 0
        return np.where(known, number, -1)

    def look_up(self, words: list[str]) -> list[bytes | None]:
        numbers = self.numbers([w.encode("utf-8", "surrogatepass") for w in words])
        at = self.at
        return [None if n < 0 else self.ids[at[n] : at[n + 1]].tobytes() for n in numbers.tolist()]


def count_pieces(docs: DataFrame, path: str, text: str = "text", window: int = COUNT_WINDOW) -> DataFrame:
    """(piece, n) over all whole texts, by lossy counting: each task drops the pieces seen only once
    every ``window`` pieces, so a piece's count lacks at most 1 in ``window``, at any size."""

    def count(batches):
        vocabulary, counts, since = Vocabulary.load(path), Counter(), 0

        def out():
            if counts:
                pieces = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.encode() for p in pieces], pa.binary()), pa.array([counts[p] for p in pieces], pa.int64())],
                    ["piece", "n"],
                )

        for batch in batches:
            for value in raw(batch, "text"):
                pieces = vocabulary.pieces(text_of(value))
                if pieces is not None:
                    counts.update(pieces)
                    since += len(pieces)
                if since >= window:
                    counts = Counter({p: n for p, n in counts.items() if n > 1 and p})
                    yield from out()
                    counts, since = Counter(), 0
        counts = Counter({p: n for p, n in counts.items() if n > 1 and p})
        yield from out()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "piece binary, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> Lexicon:
    """The ``words`` most frequent pieces (ties by bytes) of all texts, compiled on the driver."""
    top = count_pieces(docs, path, text).orderBy(F.desc("n"), "piece").limit(words).collect()
    vocabulary = Vocabulary.load(path)
    return Lexicon.compile({bytes(r["piece"]): vocabulary.merge(bytes(r["piece"]).decode()) for r in top})


def decode(ids: bytes, vocabulary: Vocabulary) -> str:
    """Text of little-endian unsigned 32-bit ids, special tokens included."""
    joined = b"".join(map(vocabulary.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    return joined.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): ids of each whole text, little-endian unsigned 32-bit."""
    return _coded(docs, path, lexicon, key, text, digest=False)


def digests(docs: DataFrame, path: str, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""
    return _coded(docs, path, lexicon, key, text, digest=True)


def _coded(docs: DataFrame, path: str, lexicon: Lexicon, key: str, text: str, digest: bool) -> DataFrame:
    spark = start(docs.sparkSession)
    shared = spark.sparkContext.broadcast(lexicon.dump())
    kind = docs.schema[key].dataType.simpleString()

    def code(batches):
        vocabulary = Vocabulary.load(path)
        encoder = Encoder(vocabulary, Lexicon.mapped(shared.value))
        for batch in batches:
            coded = encoder.encode([text_of(v) for v in raw(batch, "text")])
            if not digest:
                columns = {"ids": pa.array(coded, pa.binary())}
            else:
                sha = lambda data: hashlib.sha256(data).hexdigest()
                columns = {
                    "n_tokens": pa.array([len(ids) // 4 for ids in coded], pa.int64()),
                    "ids_sha256": pa.array(map(sha, coded), pa.string()),
                    "decoded_sha256": pa.array([sha(decode(ids, vocabulary).encode()) for ids in coded], pa.string()),
                }
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns.values()], ["key", *columns])

    out = "ids binary" if not digest else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(code, f"key {kind}, {out}")
        .withColumnRenamed("key", key)
    )
