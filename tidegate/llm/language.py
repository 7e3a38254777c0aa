"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams; a document's profile
is the same of its own text. The out-of-place distance adds up, over the document's n-grams, by how
many places the two ranks differ, and counts n-grams that the language's list lacks as out by the
whole length of the list. The nearest language is the prediction.

Cases: null texts and texts without a letter are ``und`` with score 0, and so is everything when no
labelled row is there to learn from; ties in rank go to the smaller n-gram hash, ties in distance to
the smaller name. Rows with null or empty lang are never learnt from; rows with a null key count as
not held out. Repeated ids give a row each; texts are read whole; only key, text and lang are read, so
other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import groups, kept_out, mix, of_texts, raw, start, text_of, tidy
from tidegate.session import broadcast_if_small
from tidegate.llm.toxicity import words

GRAMS = (1, 2, 3, 4)
RANKS = 300
SAMPLE_PER_LANGUAGE = 3_000  # bound of the learning sample, in documents, met on average
GROUP_LETTERS = 400_000  # documents worked on together hold about so many letters
UNKNOWN = "und"


def word_grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word's n-grams, with a mark at both ends, and how many each word has."""
    marked = ["_" + w.decode("utf-8", "replace") + "_" for w in vocabulary]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(marked)), sizes)
    left = ends[word] - np.arange(len(letters))
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(letters), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            shifted = letters[n - 1 :]
            rolling = rolling * np.uint64(0x100000001B3)
            rolling[: len(shifted)] += shifted + np.uint64(1)
            if n in GRAMS:
                ok = np.nonzero((left >= n) & ((n > 1) | (letters != ord("_"))))[0]
                owners.append(word[ok])
                hashes.append(mix(rolling[ok] + np.uint64(n)))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return hashed[order], np.bincount(owner, minlength=len(marked))


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram hash, count), by text and hash, of a few texts taken together."""
    number: dict[bytes, int] = {}
    docs, items, times = [], [], []
    for i, text in enumerate(texts):
        seen: dict[bytes, int] = {}
        for w in words(text):
            seen[w] = seen.get(w, 0) + 1
        docs.append(np.full(len(seen), i))
        items.extend(number.setdefault(w, len(number)) for w in seen)
        times.extend(seen.values())
    if not number:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashed, sizes = word_grams(list(number))
    kinds, gram = np.unique(hashed, return_inverse=True)
    at = np.cumsum(sizes) - sizes
    item = np.array(items)
    many = sizes[item]
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key = np.repeat(np.concatenate(docs), many) * len(kinds) + gram[np.repeat(at[item], many) + place]
    weight = np.repeat(np.array(times), many)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    key = key[first]
    return key // len(kinds), kinds[key % len(kinds)], np.add.reduceat(weight, first)


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, rank from 0) of each text's ``most`` most frequent n-grams."""
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, doc, side="left")
    rank = np.arange(len(doc)) - first
    kept = rank < most
    return doc[kept], gram[kept], rank[kept]


@dataclass
class Profiles:
    """``rank[language, n-gram]`` over all listed n-grams in order of hash; ``RANKS`` where not listed."""

    names: list[str]
    grams: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        names = sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64).astype(np.uint64))
        rank = np.full((len(names), len(grams)), RANKS, dtype=np.int64)
        for name, gram, place in rows:
            rank[names.index(name), np.searchsorted(grams, np.int64(gram).astype(np.uint64))] = place
        return cls(names, grams, rank)

    def identify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Prediction and score: 1 - distance / largest possible distance."""
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.names:
            return found, scores
        for part in groups(texts, GROUP_LETTERS):
            some = texts[part]
            doc, gram, rank = ranked(*counted(some))
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            listed = self.grams[at] == gram
            size = np.bincount(doc, minlength=len(some))
            far = np.stack(
                [
                    np.bincount(doc, np.where(listed & (r[at] < RANKS), abs(rank - r[at]), RANKS), minlength=len(some))
                    for r in self.rank
                ]
            )
            best = far.argmin(0)
            for i, text in enumerate(some):
                if size[i] and any(map(str.isalpha, text)):
                    found[part.start + i] = self.names[best[i]]
                    scores[part.start + i] = float(1 - far[best[i], i] / (RANKS * size[i]))
        return found, scores


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> Profiles:
    """Profiles from rows that are not held out. Each language gives the rows whose hashed keys fall
    below the share that makes ``sample_per_language`` of it; counts are added up by the tasks."""
    start(docs.sparkSession)
    known = docs.where(F.col(text).isNotNull() & (F.col(lang) != "") & ~kept_out(key)).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.count(F.lit(1))).alias("share"))
    dice = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A row a language: unless there are very many, texts stay where they are.
    sample = known.join(broadcast_if_small(share)[0], "lang").where(dice < F.col("share")).select("lang", "text")

    def count(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = [text_of(v) for v in raw(batch, "text")]
            for part in groups(texts, GROUP_LETTERS):
                doc, gram, times = counted(texts[part])
                of = names[part][doc] if len(doc) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of, pa.string()), pa.array(gram.astype(np.int64), pa.int64()), pa.array(times, pa.int64())],
                    ["lang", "gram", "n"],
                )

    counts = sample.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counts.withColumn("place", place).where(F.col("place") < RANKS)
    return Profiles.of([(r["lang"], r["gram"], r["place"]) for r in top.collect()])


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row."""
    shared = start(docs.sparkSession).sparkContext.broadcast(profiles)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found, scores = shared.value.identify([text_of(v) for v in raw(batch, "text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                ["key", "held_out", "lang_pred", "score"],
            )

    return (
        docs.select(F.col(key).alias("key"), kept_out(key).alias("held_out"), F.col(text).alias("text"))
        .mapInArrow(tidy(run), f"key {kind}, held_out boolean, lang_pred string, score double")
        .withColumnRenamed("key", key)
    )


def in_a_language(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in some learnt language, unchanged, in one pass: those without
    a letter, and those that share no n-gram with any profile, go."""
    shared = start(docs.sparkSession).sparkContext.broadcast(profiles)
    return docs.where(of_texts(lambda: lambda texts: shared.value.identify(texts)[1])(F.col(text)) > 0)
