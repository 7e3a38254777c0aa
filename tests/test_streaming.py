import pytest
from pyspark.sql import functions as F

from tidegate.errors import ResourceError
from tidegate.operators import verdict as verdicts
from tidegate.operators.intake import accepted, rejected
from tidegate.plans import catalog, seeds
from tidegate.plans.chain import screen
from tidegate.plans.profiles import build
from tidegate.plans.stages import DictionaryRuleStage
from tidegate.session import shared_dir
from tidegate.sources.prompts import stream_prompts
from tidegate.streaming import jobs
from conftest import SF


def prompt_files(spark, tmp_path, files=5):
    path = str(tmp_path / "prompts")
    raw = seeds.document_prompts(spark, SF, seeds.RAW_TEXT).select("prompt_id", "text", "session_id")
    raw.repartition(files).write.parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dictionary_stage_in_a_stream(spark, banks, tmp_path):
    path = prompt_files(spark, tmp_path)
    stages = [DictionaryRuleStage(banks.patterns, banks.keyword_frame(spark))]
    done = jobs.screen_to_table(stream_prompts(spark, path, files_per_trigger=2), stages, str(tmp_path / "out"))
    assert rows(verdicts.flat(done)) == rows(verdicts.flat(screen(accepted(spark.read.parquet(path)), build("default"))))
    joined = [DictionaryRuleStage(banks.patterns, banks.keyword_frame(spark), max_probe_rows=0)]
    with pytest.raises(ResourceError, match="stream"):
        screen(accepted(stream_prompts(spark, path)), joined)


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    path = prompt_files(spark, tmp_path)
    stages, home = build("default"), str(tmp_path / "out")
    stream = stream_prompts(spark, path, files_per_trigger=2)
    done = jobs.screen_to_table(stream, stages, home)
    batch = screen(accepted(spark.read.parquet(path)), stages)
    assert rows(verdicts.flat(done)) == rows(verdicts.flat(batch))
    again = jobs.screen_to_table(stream_prompts(spark, path, files_per_trigger=2), stages, home)
    assert again.count() == batch.count()
    spark.read.parquet(path).limit(3).withColumn("prompt_id", F.concat(F.lit("new"), "prompt_id")).write.mode(
        "append").parquet(path)
    later = jobs.screen_to_table(stream_prompts(spark, path), stages, home)
    assert later.count() == screen(accepted(spark.read.parquet(path)), stages).count()


def test_stream_split_and_counts(spark, tmp_path):
    path = prompt_files(spark, tmp_path)
    raw = spark.read.parquet(path)
    good, bad = jobs.split_to_tables(stream_prompts(spark, path, files_per_trigger=2), str(tmp_path / "split"))
    columns = ["prompt_id", "text", "session_id"]
    assert rows(good.select(columns)) == rows(accepted(raw).select(columns))
    assert rows(bad.select("prompt_id", "reject_reason")) == rows(rejected(raw).select("prompt_id", "reject_reason"))
    counts = jobs.count_to_table(stream_prompts(spark, path, files_per_trigger=2), build("default"),
                                 home=str(tmp_path / "counts"))
    want = screen(accepted(raw), build("default")).groupBy("label").count()
    assert {r.label: r.prompts for r in counts.collect()} == {r.label: r["count"] for r in want.collect()}


def test_counts_keep_few_versions_and_survive_restarts(spark, tmp_path):
    path, home = prompt_files(spark, tmp_path, files=7), str(tmp_path / "counts")
    raw = spark.read.parquet(path)

    def run():
        stream = stream_prompts(spark, path, files_per_trigger=1).withColumn("day", F.expr("nullif(length(prompt_id), 1)"))
        return jobs.count_to_table(stream, build("default"), "day", home=home)

    def batch():
        prompts = accepted(spark.read.parquet(path)).withColumn("day", F.expr("nullif(length(prompt_id), 1)"))
        return screen(prompts, build("default")).groupBy("day", "label", "code").agg(F.count(F.lit(1)).alias("prompts"))

    assert rows(run()) == rows(batch())
    versions = sorted((tmp_path / "counts" / "counts").glob("batch=*"), key=lambda p: int(p.name[6:]))
    assert [p.name for p in versions] == ["batch=5", "batch=6"]
    # A version that a crash left unfinished is neither read nor built on.
    (tmp_path / "counts" / "counts" / "batch=7").mkdir()
    raw.limit(5).withColumn("prompt_id", F.concat(F.lit("again"), "prompt_id")).coalesce(1).write.mode("append").parquet(path)
    assert rows(run()) == rows(batch())
    assert rows(run()) == rows(batch())


def test_counts_of_an_empty_stream(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "prompt_id string, text string, session_id string").write.parquet(path)
    assert jobs.count_to_table(stream_prompts(spark, path), build("default"), home=str(tmp_path / "c")).count() == 0


def test_stream_queries_read_tables_that_are_folders(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    folder, file = catalog.stream_counts(spark, str(tmp_path)), catalog.stream_counts(spark, SF)
    assert rows(folder) == rows(file) and folder.count() > 0


class FakeSession:
    """``spark.checkpoint.dir`` is fixed when a session starts, so the lookup gets a stand-in."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder_setting():
    assert shared_dir(FakeSession(spark_checkpoint_dir="/shared/x/"), "job").startswith("/shared/x/job-")
    assert "job-" in shared_dir(FakeSession(spark_master="local[2]"), "job")
    with pytest.raises(ValueError):
        shared_dir(FakeSession(spark_master="yarn"), "job")
