"""Byte-level dedup against a dictionary of every window."""

import hashlib
import random

import numpy as np
import pytest
from tidegate.llm import intervals


def plain_index(texts, keys, places, least):
    first = {}
    for text, key, place in zip(texts, keys, places, strict=True):
        for i in range(len(text) - least + 1):
            window = text[i : i + least]
            first[window] = min(first.get(window, (key, place + i)), (key, place + i))
    return [
        [i for i in range(len(t) - least + 1) if (k, p + i) > first[t[i : i + least]]]
        for t, k, p in zip(texts, keys, places, strict=True)
    ]


@pytest.mark.parametrize("seed", range(120))
def test_index_equals_a_dictionary_of_windows(seed):
    rng = random.Random(seed)
    least, letters = rng.choice([2, 3, 5, 8, 13, 30, 100]), rng.choice([1, 2, 4, 20, 200])
    base = bytes(rng.randrange(letters) for _ in range(200))
    texts = []
    for _ in range(rng.randrange(1, 8)):
        text = bytes(rng.randrange(letters) for _ in range(rng.randrange(least, 150 + least)))
        cut = rng.randrange(100)
        texts.append(text[:30] + base[cut : cut + rng.randrange(100)] + text[30:] if rng.random() < 0.6 else text)
    keys = np.array([rng.randrange(5) for _ in texts])
    places = np.array([rng.randrange(4) * 10 for _ in texts])
    found = intervals.repeated(texts, keys, places, least)
    assert [f.tolist() for f in found] == plain_index(texts, keys.tolist(), places.tolist(), least)


def test_large_index_without_packed_sort_keys(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 2**21 + 5_000).astype(np.uint8)
    text[-4_000:] = text[1_000:5_000]
    suffixes, head = intervals.intervals(text, 60)
    rows = np.flatnonzero(~head)
    assert len(rows) >= 3_900
    for i in rows[::97]:
        a, b = suffixes[i - 1], suffixes[i]
        assert bytes(text[a : a + 60]) == bytes(text[b : b + 60])


def plain(docs):
    first = {}
    for key, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - 99) if key is not None else ():
            window = data[i : i + 100]
            if (key, i) < first.get(window, (key, i + 1)):
                first[window] = (key, i)
    out = []
    for key, text in docs:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 99) if key is not None else ():
            if first[data[i : i + 100]] < (key, i):
                covered[i : i + 100] = b"\1" * 100
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        out.append((key, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs):
    rows = [(key, text, 7, "x") for key, text in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block int, rows string").repartition(4)
    found = intervals.digests(frame)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs)


def corpus():
    rng = random.Random(4)

    def prose(n):
        return " ".join(rng.choice(["alpha", "béta", "gam", "délta", "x", "omega"]) + str(rng.randrange(50)) for _ in range(n))

    passage, base = prose(40), [prose(120) for _ in range(6)]
    near = base[1][:200] + "#" + base[1][201:500] + base[1][520:]
    docs = [*base, base[0], base[0], near, base[2][150:] + base[3][:300], passage, prose(5) + passage + prose(5)]
    docs += [prose(30) + passage + prose(30) for _ in range(12)]
    docs += [None, "", "x" * 99, "x" * 100, "x" * 101, "y" * 3000, "ab" * 400 + passage, "line\n" * 100, "é" * 80]
    return list(enumerate(docs))


@pytest.mark.parametrize("hot", [8_000, 3])
def test_mixed_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(intervals, "HOT", hot)
    monkeypatch.setattr(intervals, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(intervals, "ANCHORS_PER_BUCKET", 100)
    monkeypatch.setattr(intervals, "INDEX_BYTES", 6_000)
    check(spark, corpus())


def test_one_block_short_segments(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SEGMENT", 150)
    monkeypatch.setattr(intervals, "LONGEST_PIECE", 70)
    monkeypatch.setattr(intervals, "PART_BYTES", 500)
    check(spark, corpus())


def test_repeated_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_BYTES", 500)
    texts = [text for _, text in corpus()]
    docs = [(5, t) for t in texts[:12]] + [(5, texts[0]), (5, texts[0]), (None, texts[1]), (None, None), (2, texts[3]), (-9, texts[4])]
    check(spark, docs)


def test_no_documents(spark):
    check(spark, [])
    check(spark, [(None, "z" * 200)])
    check(spark, [(1, None)])
