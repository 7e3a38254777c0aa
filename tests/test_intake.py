import json

from pyspark.sql import functions as F

from tidegate.functions.text import WHITESPACE
from tidegate.operators.intake import accepted, judge, rejected, with_correlation_id
from tidegate.sources.prompts import from_table, parse_requests, read_prompts, read_requests, spread


def test_bounds_and_strip(prompts):
    raw = prompts(None, "", "   ", "a" * 8193, "  hello  ", "Hello", "a" * 8190 + " " * 10, "a" * 8192, "é" * 8192,
                  "\U0001f600" * 8192, " \x1f x y　\n", WHITESPACE)
    reasons = [r.reject_reason for r in judge(raw).orderBy("prompt_id").collect()]
    assert reasons == ["missing", "too_short", "blank", "too_long", None, None, "too_long", None, None, None, None,
                       "blank"]
    texts = [r.text for r in accepted(raw).orderBy("prompt_id").collect()]
    assert texts[0] == "hello" and texts[-1] == "x y"
    assert accepted(raw).count() + rejected(raw).count() == raw.count()


def test_strip_equals_python(prompts):
    chars = [chr(c) for c in (*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    texts = [f"{c}a{c}b{c}" for c in chars]
    got = [r.text for r in accepted(prompts(*texts)).orderBy("prompt_id").collect()]
    assert got == [t.strip() for t in texts]


def test_json_requests(spark, tmp_path):
    bodies = ['{"text": "hi", "session_id": "s1"}', '{"text": "hi"}', '{"session_id": "s1"}', '{"text": 5}',
              '{"text": "hi", "session_id": 5}', "not json", "[]", '{"text": null}', '{"text": "  "}', '"hi"',
              '{"text": "a", "more": {"b": 1}}', '{"text": "hi", "session_id": null}', '{"text": ["hi"]}']
    path = tmp_path / "requests.jsonl"
    path.write_text("\n".join(bodies))
    frame = spark.createDataFrame(list(enumerate(bodies)), "prompt_id int, body string")
    rows = judge(parse_requests(frame, "body", "prompt_id")).orderBy("prompt_id").collect()
    assert [r.reject_reason for r in rows] == [None, None, "missing", "not_text", "bad_session", "malformed",
                                               "malformed", "missing", "blank", "malformed", None, None, "not_text"]
    assert (rows[0].text, rows[0].session_id) == ("hi", "s1")
    assert judge(read_requests(spark, str(path))).where("reject_reason is null").count() == 4


def test_prompt_tables(spark, tmp_path):
    path = str(tmp_path / "prompts")
    spark.createDataFrame([("1", "hi", None)], "prompt_id string, text string, session_id string").write.json(path)
    assert read_prompts(spark, path, "json").columns == ["prompt_id", "text", "session_id"]
    table = spark.createDataFrame([(1, "hi", "en")], "id long, body string, lang string")
    assert from_table(table, "id", F.col("body"), None, "lang").first() == ("1", "hi", None, "en")


def test_spread_only_few_splits(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("prompt_id"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    df.repartition(20).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert spread(many) is many
    assert spread(many, partitions=5).rdd.getNumPartitions() == 5


def test_correlation_ids(prompts):
    frame = prompts("a", "b", "a").withColumn("correlation_id", F.when(F.col("text") == "b", F.lit("given")))
    first, again = (with_correlation_id(frame, "correlation_id", "prompt_id", "text").orderBy("prompt_id").collect()
                    for _ in range(2))
    assert first == again and first[1].correlation_id == "given"
    assert [len(r.correlation_id) for r in first] == [36, 5, 36] and first[0] != first[2]
    random_ids = with_correlation_id(prompts("a", "b")).collect()
    assert len({r.correlation_id for r in random_ids}) == 2
    assert json.dumps(first[0].correlation_id)
