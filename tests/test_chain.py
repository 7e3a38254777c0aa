import json

import pytest
from pyspark.sql import functions as F

from tidegate.errors import ResourceError, ScreenError, StageError
from tidegate.model import CLINICAL_LABELS, INJECTION_LABELS
from tidegate.operators import reports
from tidegate.operators import trace as tracing
from tidegate.operators import verdict as verdicts
from tidegate.operators.scoring import attach_predictions, from_column, parse_json
from tidegate.plans.chain import inspect, screen, stage_results
from tidegate.plans.profiles import build, load_profile, register, registered
from tidegate.plans.stages import ColumnStage, PythonStage, RuleStage, attack_stage, semantic_stage


def fixed(name, label, confidence=0.5, short_circuit=False, trigger=None):
    return ColumnStage(name, lambda df: F.struct(
        F.lit(label).alias("label"), F.lit(float(confidence)).alias("confidence"),
        F.lit(trigger).cast("string").alias("triggered_by"), F.lit(short_circuit).alias("short_circuit")))


def broken(name):
    return fixed(name, "Valid", 7.0)


def one(prompts, *stages, **kw):
    return verdicts.flat(screen(prompts("some text"), stages, **kw)).first()


@pytest.mark.parametrize("first, second, label, stage", [
    (("Valid", 0), ("Valid", 0), "Valid", "s1"),
    (("Crisis", 1), ("Valid", 0), "Crisis", "s1"),
    (("Malign", 1), ("Valid", 0), "Malign", "s1"),
    (("Malign", 0), ("Crisis", 0), "Crisis", "s2"),
    (("Valid", 0), ("Malign", 0), "Malign", "s2"),
    (("Server Error", 0), ("Malign", 0), "Malign", "s2"),
    (("Valid", 1), ("Crisis", 1), "Valid", "s1"),
])
def test_merge_and_short_circuit(prompts, first, second, label, stage):
    stages = [fixed("s1", first[0], 0.9, bool(first[1])), fixed("s2", second[0], 0.4, bool(second[1]))]
    row = one(prompts, *stages)
    assert (row.label, row.stage) == (label, stage)
    ran = inspect(prompts("some text"), stages).first()
    assert len(ran.trace) == (1 if first[1] else 2)


def test_codes(prompts):
    codes = {label: one(prompts, fixed("s", label)).code for label in ("Valid", "Malign", "Crisis", "Server Error")}
    assert codes == {"Valid": 100, "Malign": 400, "Crisis": 406, "Server Error": 500}


def test_errors_hide_everything(prompts):
    for stages in ([broken("s1")], [fixed("s1", "Malign", trigger="t"), broken("s2")]):
        row = screen(prompts("secret"), stages).first()
        assert (row.code, row.label) == (500, "Server Error")
        assert (row.data.processed_text, row.data.confidence_score) == ("", 0.0)
        assert row.data.metadata == {"reason": "System integrity error"}
        ran = inspect(prompts("secret"), stages).first()
        assert ran.trace == [] and ran.skipped_stages == [s.name for s in stages] and ran.total_stages == len(stages)
        assert ran.failed_stage == stages[-1].name


def test_stage_after_blocking_result_cannot_fail(prompts):
    assert one(prompts, fixed("s1", "Crisis", short_circuit=True), broken("s2")).label == "Crisis"


def test_returned_error_label_keeps_text(prompts):
    row = one(prompts, fixed("s1", "Server Error"))
    assert (row.code, row.processed_text, row.reason) == (500, "some text", None)


def test_metadata_keys(prompts):
    def meta(trigger):
        return screen(prompts("x"), [fixed("s", "Valid", trigger=trigger)]).first().data.metadata

    assert meta(None) == meta("") == {"stage": "s"}
    assert meta("why") == {"stage": "s", "triggered_by": "why"}


@pytest.mark.parametrize("confidence", [-0.01, 1.01, float("nan")])
def test_confidence_bounds(prompts, confidence):
    assert one(prompts, fixed("s", "Valid", confidence)).label == "Server Error"


def test_unknown_label_is_an_error(prompts):
    assert one(prompts, fixed("s", "Odd")).label == "Server Error"


def test_needs_a_stage(prompts):
    with pytest.raises(ValueError):
        screen(prompts("x"), [])


def test_skipped_keeps_order_and_duplicates(prompts):
    stages = [fixed("det", "Malign", short_circuit=True), fixed("zzz", "Valid"), fixed("aaa", "Valid"),
              fixed("zzz", "Valid"), fixed("det", "Valid")]
    row = inspect(prompts("x"), stages).first()
    assert row.skipped_stages == ["zzz", "aaa", "zzz"] and row.total_stages == 5
    body = json.loads(tracing.as_json(inspect(prompts("x"), stages)).first().inspection)
    assert body["final"]["code"] == 400 and body["trace"][0]["triggered_by"] is None


def test_audit_mode_runs_everything(prompts):
    stages = [fixed("a", "Malign", short_circuit=True), fixed("b", "Crisis", short_circuit=True)]
    assert one(prompts, *stages, short_circuit=False).label == "Crisis"
    long = verdicts.merge_long(stage_results(prompts("x"), stages, short_circuit=False)).first()
    assert (long.label, long.stage) == ("Crisis", "b")
    bad = verdicts.merge_long(stage_results(prompts("x"), [fixed("a", "Crisis"), broken("b")])).first()
    assert (bad.label, bad.stage, bad.score) == ("Server Error", None, 0.0)


def test_verdict_json(prompts, banks):
    body = json.loads(verdicts.as_json(screen(prompts("  keep Me "), [RuleStage(banks)])).first().verdict)
    assert body == {"code": 100, "label": "Valid", "data": {
        "processed_text": "  keep Me ", "confidence_score": 1.0, "metadata": {"stage": "deterministic"}}}


CLINICAL = [("LABEL_0", 0.95, "Valid"), ("LABEL_0", 0.30, "Valid"), ("LABEL_1", 0.92, "Crisis"),
            ("label_1", 0.90, "Crisis"), ("LABEL_1", 0.60, "Valid"), ("LABEL_1", 0.75, "Crisis"),
            ("suicide", 0.95, "Crisis"), ("toxic", 0.91, "Malign"), ("toxic", 0.50, "Valid"),
            ("unsafe", 0.83, "Malign"), ("UNKNOWN_LABEL", 0.99, "Valid")]
INJECTION = [("SAFE", 0.97, "Valid"), ("SAFE", 0.30, "Valid"), ("INJECTION", 0.96, "Malign"),
             ("INJECTION", 0.85, "Malign"), ("INJECTION", 0.70, "Valid"), ("UNKNOWN", 0.99, "Valid")]


@pytest.mark.parametrize("cases, make", [
    (CLINICAL, lambda p: semantic_stage("m", 0.75, predictions=p)), (INJECTION, lambda p: attack_stage("m", predictions=p))])
def test_model_stage_rows(spark, cases, make):
    rows = [(f"{i:02d}", "t", None, [{"label": raw, "score": s}]) for i, (raw, s, _) in enumerate(cases)]
    schema = "prompt_id string, text string, session_id string, preds array<struct<label:string,score:double>>"
    got = stage_results(spark.createDataFrame(rows, schema), [make(from_column("preds"))]).orderBy("prompt_id").collect()
    for (raw, score, label), row in zip(cases, got):
        assert (row.label, row.confidence, row.triggered_by) == (label, score, f"model:m|raw_label:{raw}")
        assert row.short_circuit == (label in ("Crisis", "Malign"))


def test_malformed_predictions(spark):
    good = ['[{"label": "A", "score": 0.5}]', '[{"label": "A", "score": "1e-1"}]', '[{"label": "A", "score": true}]',
            '[{"label": "A", "score": 1}, 7]', '[{"label": "A", "score": " 0.2 "}]', '[{"label": "A", "score": "1_0"}]']
    bad = ["[]", "{}", "", "null", '[{"label": "A"}]', '[{"score": 0.5}]', '[{"label": 3, "score": 0.5}]', '["A"]',
           '[{"label": "A", "score": "x"}]', '[{"label": "A", "score": null}]', '[{"label": "A", "score": [1]}]',
           '[{"label": "A", "score": "0.5f"}]', '{"label": "A", "score": 0.5}', "[[1]]", '"A"']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, raw string")
    rows = frame.select("i", parse_json(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [r.p.score for r in rows[: len(good)]] == [0.5, 0.1, 1.0, 1.0, 0.2, 10.0]
    assert all(r.p.error_type == "ValueError" and r.p.label is None for r in rows[len(good):])


def test_missing_prediction_fails_closed(spark, prompts):
    preds = spark.createDataFrame([("p00000", [("LABEL_1", 0.9)])], "prompt_id string, preds array<struct<label:string,score:double>>")
    frame = attach_predictions(prompts("a", "b"), preds, "clinical")
    rows = screen(frame, [semantic_stage("m", 0.5, predictions=from_column("clinical"))]).orderBy("prompt_id").collect()
    assert [r.label for r in rows] == ["Crisis", "Server Error"]


def test_reports_on_small_input(spark, prompts, banks):
    stages = [RuleStage(banks), fixed("later", "Valid", 0.5)]
    texts = ["self harm", "a", "b", "last night", "last night"]
    inspected = inspect(prompts(*texts), stages)
    funnel = {r.stage: (r.executed, r.blocked, r.skipped, r.failed) for r in reports.stage_funnel(inspected).collect()}
    assert funnel == {"deterministic": (5, 3, 0, 0), "later": (2, 0, 3, 0)}
    top = [(r.triggered_by, r.prompts) for r in reports.top_triggers(screen(prompts(*texts), stages), 1).collect()]
    assert top == [("keyword:last night", 2)]
    usage = {r.keyword: r.prompts for r in reports.keyword_usage(prompts(*texts), banks).collect()}
    assert usage["last night"] == 2 and usage["self harm"] == 1 and len(usage) == 153
    scored = spark.createDataFrame([("toxic", 0.9), ("odd", 0.9), ("LABEL_1", 0.1)], "raw_label string, score double")
    assert [r.raw_label for r in reports.unmapped_labels(scored, CLINICAL_LABELS).collect()] == ["odd"]
    assert reports.gate_report(scored, INJECTION_LABELS, 0.5).collect() == [("Valid", 3, 0)]


# --- profiles -----------------------------------------------------------------------------------


PREDICTED = {"predictions": from_column("preds")}
MODELS = {"semantic_bert": PREDICTED, "attack_detection": PREDICTED}


def test_profiles_in_order():
    assert [s.name for s in build("default")] == ["deterministic"]
    assert [s.name for s in build("clinical", inject=MODELS)] == ["deterministic", "semantic_bert"]
    full = build("full", inject=MODELS)
    assert [s.name for s in full] == ["deterministic", "semantic_bert", "attack_detection"]
    assert (full[1].threshold, full[2].threshold) == (0.75, 0.75)
    assert attack_stage(**PREDICTED).threshold == 0.85
    assert [s.name for s in build(inject=MODELS)] == [s.name for s in full]


def test_profile_overrides_and_order():
    assert build("full", {"stages.1.threshold": 0.9}, inject=MODELS)[1].threshold == 0.9
    swapped = {"stages": [{"stage": "attack_detection"}, {"stage": "deterministic"}]}
    assert [s.name for s in build(swapped, inject=MODELS)] == ["attack_detection", "deterministic"]
    with pytest.raises(ResourceError):
        build("full", {"stages.7.threshold": 0.9}, inject=MODELS)


def test_a_stage_without_a_model_cannot_be_built(spark):
    with pytest.raises(ResourceError, match="/nowhere"):
        build("clinical", {"stages.1.model_id": "/nowhere/model"})


def test_unknown_stage_is_reported_before_anything_is_built():
    with pytest.raises(ResourceError, match="invented"):
        build({"stages": [{"stage": "deterministic", "crisis": "/nowhere"}, {"stage": "invented"}]})
    with pytest.raises(ResourceError, match="nowhere"):
        build("default", banks={"crisis": "/nowhere/bank.yaml"})
    with pytest.raises(ResourceError):
        build({"stages": [{"stage": "semantic_bert"}]})
    with pytest.raises(ResourceError):
        load_profile("/nowhere.yaml")
    assert build({"stages": []}) == []


def test_register_custom_stage(prompts):
    register("always", lambda label: fixed("always", label, 0.3))
    assert "always" in registered()
    assert one(prompts, *build({"stages": [{"stage": "always", "label": "Malign"}]})).label == "Malign"


def test_python_stage(prompts):
    def process(text, session_id):
        if text == "boom":
            raise KeyError("x")
        if text == "shape":
            return {"label": "Valid"}
        return {"label": "Malign" if "bad" in text else "Valid", "confidence": 0.7, "short_circuit": "bad" in text}

    rows = stage_results(prompts("bad", "fine", "boom", "shape"), [PythonStage("mine", process)])
    rows = rows.orderBy("prompt_id").collect()
    assert [r.label for r in rows] == ["Malign", "Valid", None, None]
    assert [r.error and r.error.type for r in rows] == [None, None, "KeyError", "KeyError"]
    assert rows[0].duration_ms >= 0


def test_exceptions():
    cause = RuntimeError("x")
    assert StageError("s", cause).cause is cause and isinstance(StageError("s", cause), ScreenError)
    assert ResourceError("r").cause is None and "r" in str(ResourceError("r"))
