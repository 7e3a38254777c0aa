"""Importance resampling against a plain version that spells out every feature."""

import hashlib
import math
import re
import zlib

import pytest
from tidegate.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spelled(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    def counts(texts):
        out = [0] * 10000
        for text in texts:
            for feature in spelled(text)[1]:
                out[zlib.crc32(feature.encode()) % 10000] += 1
        return out

    s, t = counts(d[1] for d in docs), counts(target)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)
    ]
    out = []
    for key, text in docs:
        words, found = spelled(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(words)])
    drawable = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(drawable[: 5 * len(drawable) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def check(spark, docs, target):
    rows = [(key, text, "x", 1.0) for key, text in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double").repartition(4)
    found = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == plain(docs, target)
    return got


ODD = [None, "", " \t.", "A", "naïve É ÀB", "x" * 5000, "a1 B2_c3-d4 \0 e", "word " * 19, "word " * 20]


def test_equal_to_spelled_features(spark):
    docs = [(i, ODD[i % len(ODD)] if i < 18 else " ".join(f"w{(i * j) % 37}" for j in range(i % 60))) for i in range(400)]
    got = check(spark, docs, ["w1 w2 w3 w4", None, "word word É", "w5 w10 w15 w20"] * 3)
    assert sum(r[4] is not None for r in got) > 10


def test_ties_repeated_and_missing_keys(spark):
    same = "one two three four five " * 5
    docs = [(7, same)] * 60 + [(None, same)] * 30 + [(7, same + "six")] * 30
    check(spark, docs, ["six six"])


def test_spans_of_long_texts(spark, monkeypatch):
    text = "lone" + " " * 90 + " ".join(f"w{i % 11}" for i in range(400)) + "." * 100 + "z" * 100 + " a b"
    whole = [[a.tolist() for a in part] for part in resample.features([text.encode(), b"p q"])]
    monkeypatch.setattr(resample, "SPAN_BYTES", 25)
    cut = [[a.tolist() for a in part] for part in resample.features([text.encode(), b"p q"])]
    assert len(cut) > 20
    for k in range(2):
        assert sorted(zip(sum((c[0] for c in cut), []), sum((c[1] for c in cut), []))) == sorted(zip(*whole[0][:2]))
    assert sum((c[2] for c in cut), []) == whole[0][2]


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a b c")]])
def test_nothing_to_draw(spark, docs):
    check(spark, docs, ["a"])
    check(spark, docs, [])


def test_quickselect_finds_every_place(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select(
        F.col("id").alias("doc_id"), (F.col("id") * 7919 % 40).alias("score"), F.lit(1).alias("n_features"), F.lit(2).alias("weight")
    )
    rows = rows.withColumn("place", resample._place("doc_id")).cache()
    places = sorted(r.place for r in rows.collect())
    for k in (1, 2, 13, 250, 499, 500):
        assert resample.kth(rows, k) == places[k - 1]
