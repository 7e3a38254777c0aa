import json

import pytest

from tidegate.__main__ import main
from tidegate.errors import ResourceError
from tidegate.plans.chain import inspect, screen
from tidegate.plans.profiles import build
from tidegate.sources.sinks import write_bodies, write_intake

ROWS = [("1", " last night ", "s"), ("2", "fine", None), ("3", "", None), ("4", None, None)]
SCHEMA = "prompt_id string, text string, session_id string"


def test_screen_job(spark, tmp_path):
    path, out, bad = (str(tmp_path / n) for n in ("in", "out", "bad"))
    spark.createDataFrame(ROWS, SCHEMA).write.json(path)
    main(["--input", path, "--input-format", "json", "--output", out, "--output-format", "json", "--rejects", bad,
          "--profile", "default", "--trace"], spark)
    rows = {r.prompt_id: r for r in spark.read.json(out).collect()}
    assert {k: r.code for k, r in rows.items()} == {"1": 406, "2": 100}
    assert rows["1"].data.processed_text == "last night" and rows["1"].trace[0].stage == "deterministic"
    assert "failed_stage" not in spark.read.json(out).columns
    assert {r.reject_reason for r in spark.read.parquet(bad).collect()} == {"too_short", "missing"}


def test_request_job_with_own_bank(spark, tmp_path):
    bank = tmp_path / "crisis.yaml"
    bank.write_text("categories: {own: {keywords: [Blue Moon]}}")
    (tmp_path / "requests").write_text('{"text": "a blue moon", "session_id": "s"}\n{"text": "last night"}\n')
    out = str(tmp_path / "out")
    main(["--input", str(tmp_path / "requests"), "--input-format", "requests", "--output", out, "--profile", "default",
          "--bank", f"crisis={bank}"], spark)
    found = {r.session_id: r.data.metadata.get("triggered_by") for r in spark.read.parquet(out).collect()}
    assert found == {"s": "keyword:Blue Moon", None: None}
    with pytest.raises(ResourceError):
        main(["--input", "x", "--output", "y", "--set", "stages.9.threshold=1"], spark)


def test_body_and_intake_sinks(spark, tmp_path):
    frame = spark.createDataFrame(ROWS[:2], SCHEMA)
    write_bodies(screen(frame, build("default")), str(tmp_path / "verdicts"))
    write_bodies(inspect(frame, build("default")), str(tmp_path / "inspections"))
    bodies = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "verdicts")).collect()]
    assert sorted(b["code"] for b in bodies) == [100, 406]
    traces = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "inspections")).collect()]
    assert all(t["total_stages"] == 1 and len(t["trace"]) == 1 for t in traces)
    write_intake(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "intake"))
    assert spark.read.parquet(str(tmp_path / "intake/outcome=rejected")).count() == 2
