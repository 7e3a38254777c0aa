"""The physical plans are part of the contract."""

from conftest import SF
from pyspark.sql import functions as F

from tidegate.operators.dictionary import first_keywords_by_join
from tidegate.operators.intake import accepted
from tidegate.operators.scoring import from_classifier
from tidegate.plans import seeds
from tidegate.plans.catalog import QUERIES, _full_stages, _predicted
from tidegate.plans.chain import inspect, screen, stage_results
from tidegate.plans.profiles import build
from tidegate.plans.stages import DictionaryRuleStage, RuleStage, semantic_stage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def source(spark, tmp_path, files=16):
    path = str(tmp_path / "prompts")
    rows = spark.range(200).select(F.col("id").cast("string").alias("prompt_id"), F.lit("last night").alias("text"),
                                   F.lit(None).cast("string").alias("session_id"), F.lit("big" * 50).alias("ballast"))
    rows.repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_default_profile_is_native_and_shuffle_free(spark, tmp_path):
    plan = plan_of(screen(accepted(source(spark, tmp_path)).drop("ballast"), build("default")))
    assert "Exchange" not in plan and "Python" not in plan and "ballast" not in plan


def test_full_profile_has_no_shuffle(spark, tmp_path):
    model = {"factory": seeds.LetterClassifier}
    stages = build("full", inject={"semantic_bert": model, "attack_detection": model})
    plan = plan_of(screen(accepted(source(spark, tmp_path)), stages))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2
    assert plan.count("Scan parquet") == 1


def test_filters_do_not_copy_the_matching(spark, tmp_path):
    verdicts = screen(accepted(source(spark, tmp_path)), build("default"))
    plain, filtered = plan_of(verdicts), plan_of(verdicts.where(F.col("label") == "Crisis"))
    assert filtered.count("RLIKE") == plain.count("RLIKE") > 10


def test_trace_explode_stays_small(spark):
    inspected = inspect(_predicted(spark, SF), _full_stages())
    exploded = inspected.select("prompt_id", F.explode("trace"))
    assert len(plan_of(exploded)) < 2 * len(plan_of(inspected))


def test_dictionary_is_probed_in_place(spark, tmp_path):
    plan = plan_of(QUERIES["keyword_ngram_join"](spark, SF))
    assert "Join" not in plan and "Aggregate" not in plan


def test_dictionary_behind_a_model_stage_reads_once(spark, banks, tmp_path):
    model = semantic_stage("m", 0.4, predictions=from_classifier(seeds.LetterClassifier, "m", 60.0))
    stage = DictionaryRuleStage(banks.patterns, banks.keyword_frame(spark))
    plan = plan_of(screen(accepted(source(spark, tmp_path)), [model, stage]))
    assert plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_dictionary_join_shuffles_only_hits(spark, banks):
    found = first_keywords_by_join(seeds.document_prompts(spark, SF), banks.keyword_frame(spark))
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_reports_combine_before_the_shuffle(spark):
    for name in ("verdict_rollup", "stage_funnel", "merge_long"):
        assert "partial_" in plan_of(QUERIES[name](spark, SF)), name


def test_no_nested_loops_anywhere(spark):
    for name, query in QUERIES.items():
        if not name.startswith("stream"):
            plan = plan_of(query(spark, SF))
            assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_joined_dictionary_stage_shuffles_no_text(spark, banks, prompts):
    texts = ["i want to kill you", "calm", "i want to kill you", "i wish i was dead"] * 20
    stage = DictionaryRuleStage(banks.patterns, banks.keyword_frame(spark), max_broadcast_rows=0, max_probe_rows=0)
    found = stage_results(prompts(*texts), [stage]).select("prompt_id", "label", "triggered_by")
    assert "first(text" not in plan_of(found)
    plain = stage_results(prompts(*texts), [RuleStage(banks)]).select("prompt_id", "label", "triggered_by")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
