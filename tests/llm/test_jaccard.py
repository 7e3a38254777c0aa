"""PartEnum signatures: linked sets share one; joins over runs of every kind against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from tidegate.llm import jaccard

SHAPE = "doc_id long, text string"


def partner(rng, found, at_least):
    """A set that links with ``found``, by as little as the threshold allows."""
    size = len(found)
    gone = rng.randint(0, size // 4)
    kept = found[np.array(rng.sample(range(size), size - gone), dtype=np.int64)]
    most = int((size - gone) / at_least) - size  # new ones for which the share is still reached
    new = np.array([rng.getrandbits(64) for _ in range(rng.randint(max(0, most - 1), max(0, most)))], dtype=np.uint64)
    return np.unique(np.concatenate([kept, new]))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 18, 23, 40, 67, 90, 150, 280, 500, 1200])
def test_linked_sets_share_a_signature(size):
    rng, met = random.Random(size), 0
    for _ in range(60):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], dtype=np.uint64))
        y = partner(rng, x, 0.75)
        if not jaccard._alike(x, y) or jaccard.rare(x) and jaccard.rare(y):
            continue
        met += 1
        assert np.intersect1d(jaccard.signatures(x), jaccard.signatures(y)).size
    assert met > 50


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def groups(texts):
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def made(seed, lengths, count, line=""):
    """Texts with a line in common, some of them close to another one."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [f"n{rng.randrange(9)}"] * rng.randint(0, 2)
            out.append(" ".join(w) or "x")
        else:
            words = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(*lengths)))
            out.append(f"{words[: len(words) // 2]} {line} {words[len(words) // 2 :]}".strip())
    return out


def test_groups_of_brute_force(spark):
    texts = [
        *made(1, (1, 16), 200),  # sizes whose subsets have two or three ranges
        *made(2, (15, 60), 120),
        *made(3, (30, 60), 120, " ".join(f"licence{i}" for i in range(40))),  # runs longer than RUN over several bands
        *made(4, (200, 400), 30),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), SHAPE).repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == groups(texts)


def test_null_and_repeated_keys_and_clashing_columns(spark):
    text = "one two three four five six"
    rows = [(7, text, 1), (7, text, 2), (3, text, 3), (None, text, 4), (5, "", 5), (6, None, 6), (8, "other words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long").withColumnsRenamed({"component_id": "id"})
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join(docs).collect())
    assert found == [(-1, 2, -1), (3, 2, 3), (5, 0, 5), (6, 0, 6), (7, 2, 3), (7, 2, 3), (8, 1, 8)]
    kept = jaccard.distinct(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 5, 6, 8]


@pytest.mark.parametrize("size", [5, 9, 23, 67, 280, 1200])
def test_linked_sets_share_a_signature_whatever_is_frequent(size):
    rng = random.Random(size)
    for _ in range(40):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], dtype=np.uint64))
        y = partner(rng, x, 0.75)
        if not jaccard._alike(x, y) or jaccard.rare(x) and jaccard.rare(y):
            continue
        names = np.unique(rng.sample([*x, *y], rng.randint(1, size)))
        frequent = names, np.array([rng.randint(1, 9) for _ in names], dtype=np.uint8)
        assert np.intersect1d(jaccard.signatures(x, frequent), jaccard.signatures(y, frequent)).size


def test_sketches_of_any_lengths_differ_by_no_more_than_the_sets():
    rng = random.Random(5)
    for size in (1, 30, 40, 64, 65, 500, 520, 1030):
        x = np.array([rng.getrandbits(64) for _ in range(size)], dtype=np.uint64)
        y = np.concatenate([x[size // 5 :], np.array([rng.getrandbits(64) for _ in range(size // 3)], dtype=np.uint64)])
        p, q = jaccard.sketch(x), jaccard.sketch(y)
        length = min(len(p), len(q))
        for at in (length, 8):
            assert (jaccard.folded(p, at) ^ jaccard.folded(q, at)).bit_count() <= size // 5 + size // 3
    assert jaccard.folded(b"\x12\x34\x56\x78", 1) == 0x12 ^ 0x34 ^ 0x56 ^ 0x78


def test_a_passage_in_common_makes_no_candidates(spark):
    rng = random.Random(3)
    passage = " ".join(f"licence{i}" for i in range(80))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(240)) + " " + passage for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    plain = jaccard.met(jaccard.posted(docs, 4)).count()
    frequent = jaccard.frequent_shingles(docs, len(texts))
    assert plain > 60 and len(frequent[0]) == 76
    assert jaccard.met(jaccard.posted(docs, 4, frequent)).count() == 0


def test_runs_of_equal_members_are_met_once_a_bucket_and_copies_not_at_all(spark):
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    copies = spark.createDataFrame([(i, base) for i in range(40)], "id long, text string").repartition(4)
    assert jaccard.met(jaccard.posted(copies, 4)).count() == 0
    near = spark.createDataFrame([(i, f"{base} end{i}") for i in range(40)], "id long, text string").repartition(4)
    assert 40 <= jaccard.met(jaccard.posted(near, 4)).where("b is null").count() < 40 * 4 * 6  # a set has over 70 signatures


def test_groups_of_brute_force_when_names_of_sets_clash(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "NAME_BITS", 3)
    texts = [*made(8, (1, 16), 60), *made(9, (15, 60), 60), *made(10, (30, 60), 40, " ".join(f"licence{i}" for i in range(40)))]
    docs = spark.createDataFrame(list(enumerate(texts)), SHAPE).repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == groups(texts)


@pytest.mark.parametrize("known", ["none", "all, ranked at random"])
def test_groups_of_brute_force_whatever_is_frequent(spark, monkeypatch, known):
    line = " ".join(f"licence{i}" for i in range(40))
    texts = [*made(8, (1, 16), 60), *made(9, (15, 60), 60), *made(10, (30, 60), 40, line)]
    names = np.unique(np.concatenate([jaccard.shingles(text.encode()) for text in texts])) if known != "none" else np.zeros(0, np.uint64)
    ranks = np.random.default_rng(4).integers(1, 60, len(names)).astype(np.uint8)
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs, rows: (names, ranks))
    docs = spark.createDataFrame(list(enumerate(texts)), SHAPE).repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == groups(texts)
