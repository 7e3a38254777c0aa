"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character 3- to 5-grams (with marks at both ends)
and of the word itself, all hashed into one table; a text's vector is the mean over its words; a
two-class softmax stands on it. Vectors and softmax are learnt together, so a misspelling that was
never seen still shares most of its n-gram vectors with the word it comes from. At scoring time each
word comes down to one number, the difference of its two logits, and a text to the mean of these.

Cases: null, empty and wordless texts get the score of the bias alone; without labelled rows every
score is 0; with one class only, it is that class' share. Rows with a null key count as unlabelled.
Repeated ids give a row each, and repeated or contradicting labels all count. Long texts are read
whole. Only the key, the text and the label are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import give_back, groups, kept_out, mix, of_texts, raw, start, text_of, tidy, written

MOST_TOXIC, MOST_CLEAN = 2_000, 4_000  # bounds of the learning sample
BUCKETS = 1 << 16
WIDTH = 6
EPOCHS = 14
BATCH = 64
RATE = TABLE_RATE = 0.1
FLOOR = 1e-6  # AdaGrad's sum of squares at the start
START = 0.003
SCALE = 60.0
REST = 20.0
REJECT_AT = 0.7
KEPT_WORDS = 200_000
GROUP_LETTERS = 2_000_000
GROUP_WORDS = 30_000

_BLANKS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words: runs of letters, ASCII signs and digits cut them."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


def grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, one word after the other, and how many each word has."""
    marked = ["<" + w.decode("utf-8", "replace") + ">" for w in vocabulary]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(marked)), sizes)
    left = ends[word] - np.arange(len(letters))  # letters to the end of the word
    owners, buckets = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(letters), dtype=np.uint64)
        shifted = letters
        for n in range(1, 6):
            rolling = rolling * np.uint64(0x100000001B3)
            rolling[: len(shifted)] += shifted + np.uint64(1)
            shifted = letters[n:]
            if n >= 3:
                ok = np.nonzero(left >= n)[0]
                owners.append(word[ok])
                buckets.append(mix(rolling[ok] + np.uint64(n)) % np.uint64(BUCKETS))
        # The word itself: its letters with a factor for each place, summed.
        place = (ends[word] - left - (ends - sizes)[word]).astype(np.uint64)
        whole = np.add.reduceat(mix(letters * np.uint64(0x9E3779B97F4A7C15) + place), ends - sizes) if len(sizes) else rolling
    owners.append(np.arange(len(marked)))
    buckets.append(mix(whole) % np.uint64(BUCKETS))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(marked))


@dataclass
class Model:
    """``value``: what a bucket adds to the logit of label 1; ``bias``: where a text without words stands."""

    value: np.ndarray
    bias: float

    def of_words(self, vocabulary: list[bytes]) -> list[float]:
        out: list[float] = []
        for lo in range(0, len(vocabulary), GROUP_WORDS):
            bucket, n = grams(vocabulary[lo : lo + GROUP_WORDS])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            out.extend((np.add.reduceat(self.value[bucket], at) / n).tolist())
        return out


def weighed(found: list[bytes]) -> tuple[list[bytes], np.ndarray, float]:
    """Distinct words, how often each counts, and the divisor of the mean. No word counts for more
    than a fiftieth of its text, or one; ``REST`` words of no meaning steady the mean of short texts."""
    times = Counter(found)
    counts = np.minimum(np.fromiter(times.values(), dtype=np.float64, count=len(times)), 1 + len(found) // 50)
    return list(times), counts, len(found) + REST


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text as buckets and their weights in its mean vector."""
    out = []
    for text in texts:
        found, times, divisor = weighed(words(text))
        if not found:
            out.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
            continue
        bucket, n = grams(found)
        total = np.bincount(bucket, weights=np.repeat(times / n / divisor, n), minlength=BUCKETS)
        kept = np.nonzero(total)[0]
        out.append((kept, total[kept]))
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Joint training by mini-batches; every weight has its own AdaGrad rate. Classes weigh the same,
    and the bias is then moved to the classes' shares."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), -np.inf if share == 0 else np.inf)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-START, START, (BUCKETS, WIDTH)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    g_table = np.full(BUCKETS, FLOOR, dtype=np.float32)
    g_soft, g_bias = np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    order = np.arange(len(labels))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            sizes = np.array([len(texts[r][0]) for r in rows])
            bucket = np.concatenate([texts[r][0] for r in rows])
            share_of = np.concatenate([texts[r][1] for r in rows]).astype(np.float32) * SCALE
            owner = np.repeat(np.arange(len(rows)), sizes)
            hidden = np.stack(
                [np.bincount(owner, weights=table[bucket, k] * share_of, minlength=len(rows)) for k in range(WIDTH)], 1
            ).astype(np.float32)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= (weight[rows] / len(rows))[:, None]
            back = p @ soft.T
            d_soft, d_bias = hidden.T @ p, p.sum(0)
            met, where = np.unique(bucket, return_inverse=True)
            grad = np.stack(
                [np.bincount(where, weights=share_of * back[owner, k], minlength=len(met)) for k in range(WIDTH)], 1
            ).astype(np.float32)
            g_table[met] += (grad**2).mean(1)
            table[met] -= TABLE_RATE * (1 - epoch / EPOCHS) * grad / np.sqrt(g_table[met])[:, None]
            g_soft += d_soft**2
            soft -= rate * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= 0.1 * rate * d_bias / np.sqrt(g_bias)
    value = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64) * SCALE
    return Model(value, float(bias[1] - bias[0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_toxic: int = MOST_TOXIC,
    most_clean: int = MOST_CLEAN,
) -> Model:
    """Fit on labelled rows that are not held out: of each class the bounded number whose hashed
    keys are least. Texts are read whole by the tasks; the driver gets their weighted buckets."""
    start(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~kept_out(key)).select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label")
    )
    order = [F.xxhash64("key"), F.col("key")]
    chosen = known.where("label = 1").orderBy(*order).limit(most_toxic).unionByName(
        known.where("label = 0").orderBy(*order).limit(most_clean)
    )

    def bag(batches):
        for batch in batches:
            out = bags([text_of(v) for v in raw(batch, "text")])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("key")),
                    batch.column(batch.schema.get_field_index("label")),
                    pa.array([b.astype("<i4").tobytes() for b, _ in out], pa.binary()),
                    pa.array([w.astype("<f4").tobytes() for _, w in out], pa.binary()),
                ],
                ["key", "label", "buckets", "weights"],
            )

    kind = docs.schema[key].dataType.simpleString()
    sample = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "key")  # most_toxic + most_clean keys at most
        .select("key", "label", "text")
        .mapInArrow(tidy(bag), f"key {kind}, label int, buckets binary, weights binary")
    )
    # Written first, so that the driver can take them part by part without the work being done part by part.
    rows = [
        (r["key"], r["label"], hashlib.md5(r["buckets"]).digest(), np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["weights"], "<f4"))
        for r in written(sample, "bags").toLocalIterator()
    ]
    rows.sort(key=lambda r: r[:3])
    model = fit([r[3:] for r in rows], np.array([r[1] for r in rows], dtype=np.int64))
    del rows
    give_back()
    return model


class Scorer:
    """Scores texts of a task; the words met before are remembered up to a bound."""

    def __init__(self, model: Model, most: int = KEPT_WORDS):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        some = [self._scored(texts[part]) for part in groups(texts, GROUP_LETTERS)]
        return np.concatenate(some) if some else np.zeros(0)

    def _scored(self, texts: list[str]) -> np.ndarray:
        cut = [weighed(words(t)) for t in texts]
        new = set().union(*(w for w, _, _ in cut)) - self.known.keys()
        if len(new) + len(self.known) > self.most:
            self.known, new = {}, set().union(*(w for w, _, _ in cut))
        vocabulary = list(new)
        self.known.update(zip(vocabulary, self.model.of_words(vocabulary), strict=True))
        get = self.known.__getitem__
        logits = [float(np.dot(list(map(get, w)), n)) / total if w else 0.0 for w, n, total in cut]
        logits = np.array(logits, dtype=np.float64) + self.model.bias
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-logits))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    shared = start(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scorer([text_of(v) for v in raw(batch, "text")]), pa.float64())],
                ["key", "held_out", "score"],
            )

    return (
        docs.select(F.col(key).alias("key"), kept_out(key).alias("held_out"), F.col(text).alias("text"))
        .mapInArrow(tidy(run), f"key {kind}, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= REJECT_AT).cast("int"))
        .withColumnRenamed("key", key)
    )


def clean(docs: DataFrame, model: Model, text: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``reject_at``, unchanged, in one pass."""
    shared = start(docs.sparkSession).sparkContext.broadcast(model)
    return docs.where(of_texts(lambda: Scorer(shared.value))(F.col(text)) < reject_at)
