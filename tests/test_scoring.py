import os
import subprocess
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidegate.operators import inference
from tidegate.operators.inference import ChunkScorer, judged
from tidegate.operators.scoring import fit_words, from_classifier, from_ml_model
from tidegate.plans.chain import screen, stage_results
from tidegate.plans.stages import RuleStage, semantic_stage

# The workers cannot import this file, so its classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Writes one file per scored text, so calls can be counted across worker processes."""

    def __init__(self, task, model, truncation):
        self.folder = model

    def __call__(self, text):
        open(os.path.join(self.folder, f"{time.time_ns()}-{os.getpid()}"), "w").close()
        return [{"label": "LABEL_1" if "dark" in text else "LABEL_0", "score": 0.9}]


def refuse(task, model, truncation):
    raise OSError("no weights")


def test_only_survivors_are_scored(prompts, banks, tmp_path):
    texts = ["self harm"] * 30 + ["dark day"] * 5 + ["sunny"] * 5
    stages = [RuleStage(banks), semantic_stage(str(tmp_path), 0.5, factory=Counting)]
    # No global sort here: its range sampling would run the chain a second time.
    rows = screen(prompts(*texts), stages).collect()
    labels = [r.label for r in sorted(rows, key=lambda r: r.prompt_id)]
    assert labels == ["Crisis"] * 35 + ["Valid"] * 5
    assert len(os.listdir(tmp_path)) == 10


def test_filter_on_verdict_does_not_score_twice(prompts, tmp_path):
    stages = [semantic_stage(str(tmp_path), 0.5, factory=Counting)]
    kept = screen(prompts(*["dark"] * 6, *["sunny"] * 6), stages).where(F.col("label") == "Crisis")
    assert kept.count() == 6
    assert len(os.listdir(tmp_path)) == 12


def test_load_failure_marks_rows(prompts):
    rows = screen(prompts("a", "b"), [semantic_stage("m", 0.5, factory=refuse)]).collect()
    assert [r.code for r in rows] == [500, 500]
    error = stage_results(prompts("a"), [semantic_stage("m", 0.5, factory=refuse)]).first().error
    assert error.type == "ResourceError" and "no weights" in error.message


def test_a_function_factory_loads_once_a_worker(prompts, tmp_path):
    folder = str(tmp_path)

    def factory(task, model, truncation):
        open(os.path.join(folder, f"{os.getpid()}-{time.time_ns()}"), "w").close()
        return lambda text: [{"label": "LABEL_0", "score": 0.9}]

    frame = prompts(*[f"day {i}" for i in range(64)]).repartition(32)
    assert len(stage_results(frame, [semantic_stage("m", 0.5, factory=factory)]).collect()) == 64
    workers = [name.split("-")[0] for name in os.listdir(folder)]
    assert workers and len(workers) == len(set(workers))


class Batch:
    """Not made for threads: a call that meets another one says so."""

    def __init__(self):
        self.busy = False

    def __call__(self, text):
        if self.busy:
            raise RuntimeError("called while busy")
        self.busy = True
        if text == "bad":
            self.busy = False
            raise RuntimeError("bad row")
        if text == "slow":
            time.sleep(60.0)
        if text == "gone":
            os._exit(3)
        self.busy = False
        return [{"label": str(os.getpid()), "score": 0.5}]

    def batch(self, texts):
        return [self(t) for t in texts]


@pytest.fixture
def scored():
    scorers = []

    def make(load, timeout_s, chunk_rows):
        scorers.append(ChunkScorer(load, timeout_s, chunk_rows))
        return scorers[-1]

    yield make
    for scorer in scorers:
        scorer.end()


def test_bad_row_does_not_spoil_its_chunk(scored):
    class Once(Batch):
        def batch(self, texts):
            self.busy = False
            return super().batch(texts)

    got = scored(Once, 5.0, 4).score(["a", "b", "bad", "c", "d"])
    assert [r[2] for r in got] == [None, None, "RuntimeError", None, None]


def test_an_overrun_ends_the_process_and_nothing_runs_beside_the_retry(scored):
    scorer = scored(Batch, 0.4, 4)
    first = scorer.child._process.pid
    start = time.monotonic()
    got = scorer.score(["a", "slow", "b", "c"])
    assert [r[2] for r in got] == [None, "TimeoutError", None, None]
    assert time.monotonic() - start < 30
    assert scorer.rows == 2 and str(first) not in {r[0] for r in got}
    with pytest.raises(ProcessLookupError):
        os.kill(first, 0)
    assert threading.active_count() < 20 and not any("run" in t.name for t in threading.enumerate())


def test_a_classifier_that_ends_its_process(scored):
    got = scored(Batch, 5.0, 1).score(["a", "gone", "b"])
    assert [r[2] for r in got] == [None, "RuntimeError", None]


def test_short_batch_answers_fall_back_to_rows(scored):
    class Short(Batch):
        def batch(self, texts):
            return []

    assert [r[2] for r in scored(Short, None, 4).score(["a", "b"])] == [None, None]


def test_shapes_of_answers():
    good = [[{"label": "A", "score": 1}], ({"label": "A", "score": "0.5"},), [{"label": "A", "score": np.float32(1)}]]
    bad = [None, [], "A", {"label": "A"}, [None], [{"label": "A"}], [{"label": 1, "score": 1}],
           [{"label": "A", "score": None}], [{"label": "A", "score": "x"}], [{"label": "A", "score": [1]}]]
    assert [judged(raw)[2] for raw in good] == [None] * 3
    assert {judged(raw)[2] for raw in bad} == {"ValueError"}


def test_saved_word_model(spark, prompts, banks, tmp_path):
    rows = spark.createDataFrame(
        [("gloom and dark", 1), ("dark night", 1), ("sunny day", 0), ("bright sunny", 0), (None, 1), ("x", None)],
        "text string, toxic int")
    path = str(tmp_path / "model")
    fit_words(rows, "toxic").save(path)
    stages = [RuleStage(banks), semantic_stage(path, 0.5)]
    verdicts = screen(prompts("so DARK", "so sunny", "self harm", "???"), stages)
    got = verdicts.orderBy("prompt_id").collect()
    assert [r.label for r in got][:3] == ["Crisis", "Valid", "Crisis"]
    # Counts and smoothing by hand: 7 words; 5 in toxic texts, "dark" twice; 4 in others.
    dark = (3 / 12) / (3 / 12 + 1 / 11)
    assert abs(got[0].data.confidence_score - dark) < 1e-12
    assert "Python" not in verdicts._jdf.queryExecution().executedPlan().toString()


def test_null_texts_pass_through(spark):
    _, column = from_classifier(Counting, "/nowhere")(None, F.col("text"))
    frame = spark.createDataFrame([(None,), (None,)], "text string")
    assert [r.s.label for r in frame.select(column.alias("s")).collect()] == [None, None]


def test_spark_ml_scorer(spark, prompts, banks):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    train = spark.createDataFrame(
        [("gloom and dark", 1.0), ("dark night", 1.0), ("sunny day", 0.0), ("bright sunny", 0.0)],
        "scored_text string, label double")
    flow = Pipeline(stages=[RegexTokenizer(inputCol="scored_text", outputCol="tokens", pattern="\\W+"),
                            HashingTF(inputCol="tokens", outputCol="features", numFeatures=64),
                            LogisticRegression(maxIter=20)])
    source = from_ml_model(flow.fit(train))
    frame = prompts("so dark", "so sunny", "self harm")
    verdicts = screen(frame, [RuleStage(banks), semantic_stage("lr", 0.5, predictions=source)])
    rows = verdicts.orderBy("prompt_id").collect()
    assert [r.label for r in rows] == ["Crisis", "Valid", "Crisis"]
    assert rows[0].data.metadata["triggered_by"] == "model:lr|raw_label:LABEL_1"
    assert "Python" not in verdicts._jdf.queryExecution().executedPlan().toString()


def test_fitted_model_in_a_session_that_has_observed(spark, prompts):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    observed = Observation()
    spark.range(3).observe(observed, F.count(F.lit(1)).alias("n")).collect()
    assert observed.get == {"n": 3}
    train = spark.createDataFrame([("dark night", 1.0), ("sunny day", 0.0)], "scored_text string, label double")
    words = RegexTokenizer(inputCol="scored_text", outputCol="tokens", pattern="\\W+")
    counts = HashingTF(inputCol="tokens", outputCol="features", numFeatures=64)
    model = Pipeline(stages=[words, Pipeline(stages=[counts, LogisticRegression(maxIter=20)])]).fit(train)
    verdicts = screen(prompts("so dark", "so sunny"), [semantic_stage("lr", 0.5, predictions=from_ml_model(model))])
    assert [r.label for r in verdicts.orderBy("prompt_id").collect()] == ["Crisis", "Valid"]
    assert model.stages[1].stages[1].hasSummary


def test_waits_of_hung_texts_overlap(scored):
    scorer = scored(Batch, 2.0, 1)
    texts = [name for i in range(16) for name in ("slow", f"a{i}")]
    start = time.monotonic()
    got = scorer.score(texts)
    assert [r[2] for r in got] == ["TimeoutError", None] * 16
    assert time.monotonic() - start < 30  # 32 s of waits alone, one after another
    assert all(r[4] >= 2000 for r in got[::2])


def test_one_child_where_nothing_hangs(scored):
    scorer = scored(Batch, 60.0, 2)
    assert len({r[0] for r in scorer.score([f"a{i}" for i in range(50)])}) == 1
    assert [r[2] for r in scorer.score([])] == []


class Forked(Batch):
    """Says which process it was forked from, and when it was called."""

    def __call__(self, text):
        start = time.monotonic()
        if text.startswith("work"):
            time.sleep(0.1)
        super().__call__(text)
        return [{"label": f"{os.getppid()} {start} {time.monotonic()}", "score": 0.5}]


def test_an_overrun_costs_a_fork_of_one_process(scored):
    got = scored(Forked, 1.0, 1).score(["a", "slow", "b", "slow", "c"])
    parents = {int(r[0].split()[0]) for r in got if r[0]}
    assert [r[2] for r in got] == [None, "TimeoutError"] * 2 + [None]
    assert len(parents) == 1 and os.getpid() not in parents


def test_many_hung_texts(scored):
    scorer = scored(Batch, 1.0, 1)
    start = time.monotonic()
    got = scorer.score([name for i in range(64) for name in ("slow", f"a{i}")])
    assert [r[2] for r in got] == ["TimeoutError", None] * 64
    assert time.monotonic() - start < 30  # 44 s with an interpreter's start for each


def test_children_with_memory_of_their_own_stay_few(scored, monkeypatch):
    texts = [name for i in range(40) for name in ("slow", f"a{i}")]
    monkeypatch.setattr(inference, "LIGHT_BYTES", 1)
    heavy = scored(Batch, 1.0, 1)
    heavy.score(texts)
    assert heavy._wide == inference.MOST_CHILDREN >= len(heavy._children)
    monkeypatch.undo()
    light = scored(Batch, 1.0, 1)
    light.score(texts)
    assert light._wide > inference.MOST_CHILDREN


def test_calls_that_work_do_not_run_beside_each_other(scored):
    texts = [f"work{i}" for i in range(12)]
    got = scored(Forked, 2.0, 1).score(["slow", *texts, "slow", *texts, "slow"])
    assert sum(r[2] == "TimeoutError" for r in got) == 3
    at = sorted(tuple(map(float, r[0].split()[1:])) for r in got if r[0])
    assert len(at) == 24 and all(end <= start for (_, end), (start, _) in zip(at[:-1], at[1:], strict=True))


def test_nothing_outlives_the_worker(tmp_path):
    code = f"""
import os, sys, threading, time
sys.path[:0] = {[p for p in sys.path if p]!r}
from tidegate.operators.inference import ChunkScorer
def load():
    return lambda text: time.sleep(600)
scorer = ChunkScorer(load, 500.0, 1)
print(scorer._stem._process.pid, scorer.child._process.pid, flush=True)
threading.Timer(1.0, os._exit, (9,)).start()
scorer.score(["a"])
"""
    worker = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60)
    assert worker.returncode == 9
    until = time.monotonic() + 20
    for pid in map(int, worker.stdout.split()):
        while os.path.exists(f"/proc/{pid}") and open(f"/proc/{pid}/stat").read().rpartition(")")[2].split()[0] != "Z":
            assert time.monotonic() < until
            time.sleep(0.1)


@pytest.mark.parametrize("kind, line", [("warm", "import json"), ("plain", "threading.Thread(target=time.sleep, args=(600,), daemon=True).start()")])
def test_imports_are_shared_unless_they_start_threads(scored, tmp_path, monkeypatch, kind, line):
    (tmp_path / f"imported_{kind}.py").write_text(f"""
import os, threading, time
{line}
class Loaded:
    def __init__(self):
        self.threads = threading.active_count()
    def __call__(self, text):
        return [{{"label": f"{{self.threads}} {{os.getpid()}}", "score": 0.5}}]
""")
    monkeypatch.syspath_prepend(str(tmp_path))
    loaded = __import__(f"imported_{kind}").Loaded
    scorer = scored(loaded, 5.0, 1)
    assert scorer.score(["a"])[0][0] == f"{1 + (kind == 'plain')} {scorer.child._process.pid}"
    assert kind in open(f"/proc/{scorer._stem._process.pid}/cmdline").read().split("\0")
