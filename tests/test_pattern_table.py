"""Patterns from a table against Python's matcher, text by text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegate.errors import ResourceError
from tidegate.operators.pattern_table import first_hits, pattern_hits

WORDS = "ignore previous instructions system prompt reveal secret please now café straße kind of über 42 DAN".split()
ODD = [
    r"(?:\w+ )*b",  # the JVM's stack would end on long texts
    r"(please )?reveal(?(1) now| secret)",  # conditional group: no JVM form
    r"\d{2}",  # no literal
    r"über|straße",  # no ASCII literal
    r"(?:now|dan)\W+please",  # short literals
    r"(?-i:secret) prompt",
]
SHAPE = "id string, ord int, pattern string, note string"


def found(df):
    return {(r.prompt_id, r.id) for r in df.where(F.col("error").isNull()).collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return [*made, "", "b", "İGNORE ſystem prompt", "x" * 50_000 + " ignore previous", *made[:5]]


def brute(texts, patterns):
    tests = [(i, re.compile(p, re.IGNORECASE)) for i, _, p, _ in patterns]
    return {(f"p{n:05d}", i) for n, t in enumerate(texts) for i, p in tests if p.search(t.lower())}


def test_equal_to_python(spark, prompts, texts):
    rng = random.Random(5)
    phrases = {r"\W+".join(re.escape(w) for w in rng.sample(WORDS, 3)) for _ in range(3000)}
    patterns = [(f"n{i}", i, p, None) for i, p in enumerate([*ODD, *sorted(phrases)])]
    table = spark.createDataFrame(patterns, SHAPE).repartition(4)
    hits = pattern_hits(prompts(*texts), table)
    assert found(hits) == brute(texts, patterns)
    order = {i: n for i, n, _, _ in patterns}
    least = {}
    for key, i in brute(texts, patterns):
        least[key] = min(least.get(key, i), i, key=order.get)
    assert {r.prompt_id: r.id for r in first_hits(hits).collect()} == least


def test_no_nested_loop(spark, prompts):
    table = spark.createDataFrame([("a", 0, "ignore previous", None), ("b", 1, "reveal", None)], SHAPE)
    plan = pattern_hits(prompts("ignore previous"), table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" not in plan


def test_hung_pattern_is_an_error_of_its_text(spark, prompts):
    table = spark.createDataFrame([("slow", 0, r"(x+x+)+(?(1)y|z)", None), ("ok", 1, "plain", None)], SHAPE)
    rows = pattern_hits(prompts("x" * 64 + " plain", "xxy"), table, timeout_s=0.5).collect()
    assert sorted((r.prompt_id, r.id, r.error) for r in rows) == [
        ("p00000", "ok", None), ("p00000", "slow", "TimeoutError"), ("p00001", "slow", None),
    ]


def test_edges(spark, prompts):
    table = spark.createDataFrame([("a", 1, "beta", None), ("a", 0, "alpha", None), ("z", 2, "beta", None)], SHAPE)
    rows = pattern_hits(prompts("beta", None, "alpha beta", "alpha beta"), table)
    assert found(rows) == {("p00000", "a"), ("p00000", "z"), ("p00002", "a"), ("p00002", "z"), ("p00003", "a"), ("p00003", "z")}
    assert {(r.prompt_id, r.ord) for r in rows.where("id = 'a'").collect()} == {("p00000", 1), ("p00002", 0), ("p00003", 0)}
    assert pattern_hits(prompts("beta"), table.where("false")).count() == 0
    assert pattern_hits(prompts("beta").where("false"), table).count() == 0
    for bad in (("q", 0, "(", None), (None, 0, "a", None), ("q", 0, None, None)):
        with pytest.raises(ResourceError, match="pattern"):
            pattern_hits(prompts("beta"), spark.createDataFrame([bad], SHAPE))


def test_letters_of_phrases(spark, prompts):
    from tidegate.functions.patterns import needed_letters

    phrase = r"(?:^|[^a-z])alpha[^a-z]+beta[^a-z]+of(?:$|[^a-z])"
    assert needed_letters("p", phrase) == ("alphabetaof",)
    assert needed_letters("p", r"(?-i:alpha) beta") == ("beta",)
    table = spark.createDataFrame([("p", 0, phrase, None)], SHAPE)
    texts = ["alpha, BETA\n of", "alpha beta", "alpha x beta of", "xalpha beta of", "1alpha2beta3of", "of beta alpha", "Ünalpha beta of",
             *(f"{'z ' * n}alpha  beta of" for n in range(12))]
    assert found(pattern_hits(prompts(*texts), table)) == brute(texts, [("p", 0, phrase, None)])


def test_words_in_another_order_are_no_candidates(spark, prompts):
    """All words of the phrase stand in the text, but not as neighbours: nothing is left to try."""
    from tidegate.operators.pattern_table import _candidates, compiled

    table = compiled(spark.createDataFrame([("p", 0, r"(?:^|[^a-z])wonder[^a-z]+stone[^a-z]+garden(?:$|[^a-z])", None)], SHAPE))
    texts = prompts("garden stone wonder", "stone wonder garden", "a wonder stone garden").select("prompt_id", "text")
    assert [r.prompt_id for r in _candidates(texts, table, "prompt_id").collect()] == ["p00002"]
