"""One query per operator, each over whole tables. Keys match :mod:`tidegate.plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.labels import gate, normalise_label
from tidegate.model import CLINICAL_LABELS, INJECTION_LABELS, MALIGN, VALID
from tidegate.operators import intake, reports
from tidegate.operators import trace as tracing
from tidegate.operators import verdict as verdicts
from tidegate.operators.dictionary import PROBE_ROWS, first_keywords
from tidegate.operators.pattern_table import first_hits, pattern_hits
from tidegate.operators.rules import (
    all_keywords,
    all_patterns,
    first_keyword,
    first_pattern,
    keyword_hits,
    match_columns,
    severity,
)
from tidegate.operators.scoring import (
    attach_predictions,
    fit_words,
    from_classifier,
    from_column,
    from_saved_model,
    parse_json,
)
from tidegate.plans import seeds
from tidegate.plans.chain import inspect, screen, screen_observed, stage_results
from tidegate.plans.profiles import build
from tidegate.plans.stages import (
    ColumnStage,
    DictionaryRuleStage,
    ModelStage,
    PythonStage,
    RuleStage,
    attack_stage,
    semantic_stage,
)
from tidegate.session import shared_dir, ship
from tidegate.sources.banks import Banks, keyword_frame
from tidegate.sources.prompts import parse_requests
from tidegate.streaming import jobs

CLINICAL_MODEL = "stand-in/clinical"
INJECTION_STAND_IN = "stand-in/injection"


def _accepted(spark: SparkSession, sf_dir: str, **extra: str) -> DataFrame:
    return intake.accepted(seeds.document_prompts(spark, sf_dir, **extra))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that is there, of any length: matching itself has no bound."""
    return seeds.document_prompts(spark, sf_dir).where(F.col("text").isNotNull())


# --- model predictions as columns ---------------------------------------------------------------

_CLINICAL = f"""CASE {seeds.CLINICAL_SHAPE}
    WHEN 0 THEN array()
    WHEN 1 THEN array(named_struct('label', CAST(NULL AS STRING), 'score', {seeds.CLINICAL_SCORE}))
    WHEN 2 THEN array(named_struct('label', {seeds.CLINICAL_LABEL}, 'score', CAST(NULL AS DOUBLE)))
    WHEN 3 THEN array(named_struct('label', {seeds.CLINICAL_LABEL}, 'score', CAST(1.5 AS DOUBLE)))
    ELSE array(named_struct('label', {seeds.CLINICAL_LABEL}, 'score', {seeds.CLINICAL_SCORE})) END"""
_ATTACK = f"array(named_struct('label', {seeds.ATTACK_LABEL}, 'score', {seeds.ATTACK_SCORE}))"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir, clinical=_CLINICAL, attack=_ATTACK)


def _clinical_stage(threshold: float = 0.75) -> ModelStage:
    return semantic_stage(CLINICAL_MODEL, threshold, predictions=from_column("clinical"))


def _attack_stage(threshold: float = 0.85) -> ModelStage:
    return attack_stage(INJECTION_STAND_IN, threshold, predictions=from_column("attack"))


def _full_stages() -> list:
    return build(
        "full",
        overrides={"stages.1.model_id": CLINICAL_MODEL, "stages.2.model_id": INJECTION_STAND_IN},
        inject={
            "semantic_bert": {"predictions": from_column("clinical")},
            "attack_detection": {"predictions": from_column("attack")},
        },
    )


def _full_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(_predicted(spark, sf_dir), _full_stages())


def _raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("prompt_id"),
        F.expr(seeds.CLINICAL_LABEL).alias("raw_label"),
        F.expr(seeds.CLINICAL_SCORE).alias("score"),
    )


# --- intake -------------------------------------------------------------------------------------


def validate_prompts(spark, sf_dir):
    raw = seeds.document_prompts(spark, sf_dir, seeds.RAW_TEXT)
    return intake.accepted(raw).select("prompt_id", "session_id", "text", F.length("text").alias("chars"))


def rejected_prompts(spark, sf_dir):
    raw = seeds.document_prompts(spark, sf_dir, seeds.RAW_TEXT)
    return intake.rejected(raw).select("prompt_id", "reject_reason", F.length("text").alias("raw_chars"))


_BODY = """CASE doc_id % 9
    WHEN 0 THEN '{"text": ' || CAST(doc_id AS STRING) || '}'
    WHEN 1 THEN '{"session_id": "only"}'
    WHEN 2 THEN '{"text": "cut'
    WHEN 3 THEN to_json(named_struct('text', text, 'session_id', doc_id))
    WHEN 4 THEN to_json(named_struct('text', text, 'session_id', source, 'extra', lang))
    WHEN 5 THEN '[1, 2]'
    ELSE to_json(named_struct('text', text)) END"""


def json_intake(spark, sf_dir):
    bodies = seeds.documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("prompt_id"), F.expr(_BODY).alias("body")
    )
    return intake.judge(parse_requests(bodies, "body", "prompt_id")).select(
        "prompt_id", "text", "session_id", "reject_reason"
    )


def correlation_id(spark, sf_dir):
    turns = seeds.turn_prompts(spark, sf_dir).withColumn(
        "correlation_id", F.when(F.col("source") == "system", F.concat(F.lit("req-"), "prompt_id"))
    )
    return intake.with_correlation_id(turns, "correlation_id", "prompt_id", "text").select(
        "prompt_id", "correlation_id"
    )


# --- matching -----------------------------------------------------------------------------------


def _hits(spark, sf_dir, column, name="hit"):
    return match_columns(_whole(spark, sf_dir), **{name: column}).select("prompt_id", name)


def pattern_first_hit(spark, sf_dir):
    return _hits(spark, sf_dir, first_pattern(Banks.load().patterns))


def pattern_all_hits(spark, sf_dir):
    turns = seeds.all_prompts(spark, sf_dir).where(F.col("text").isNotNull())
    ids = F.concat(all_patterns(Banks.load().patterns), all_patterns(seeds.prose_patterns()))
    return match_columns(turns, hits=F.array_join(ids, ",")).select("prompt_id", "hits")


def crisis_first_hit(spark, sf_dir):
    return _hits(spark, sf_dir, first_keyword(Banks.load().crisis))


def malign_first_hit(spark, sf_dir):
    return _hits(spark, sf_dir, first_keyword(Banks.load().malign))


def keyword_all_hits(spark, sf_dir):
    return _hits(spark, sf_dir, F.array_join(all_keywords(seeds.prose_bank()), "|"), "hits")


def keyword_ngram_join(spark, sf_dir):
    shipped = Banks.load()
    banks = keyword_frame(spark, shipped.crisis, shipped.malign, seeds.prose_bank())
    found = first_keywords(_whole(spark, sf_dir), banks)
    return found.select("prompt_id", "crisis", "malign", "prose")


def dictionary_odd_keywords(spark, sf_dir):
    """Keywords of any characters, as a dictionary."""
    banks = keyword_frame(spark, Banks.load().crisis, seeds.odd_bank())
    return first_keywords(_whole(spark, sf_dir), banks).select("prompt_id", "crisis", "odd")


def pattern_table_hits(spark, sf_dir):
    """Every pattern of a table that grows with the benchmark passages, on every document."""
    return pattern_hits(_whole(spark, sf_dir), seeds.pattern_frame(spark, sf_dir)).select("prompt_id", "id", "error")


def pattern_table_first(spark, sf_dir):
    """The first of them in the table's order."""
    return first_hits(pattern_hits(_whole(spark, sf_dir), seeds.pattern_frame(spark, sf_dir)))


def rule_stage(spark, sf_dir):
    rows = stage_results(_accepted(spark, sf_dir), [RuleStage(Banks.load())])
    return rows.select(
        "prompt_id", "stage_name", "label", "confidence", "triggered_by", "short_circuit"
    )


def _dictionary_stage(spark, **bounds):
    banks = Banks.load()
    return DictionaryRuleStage(banks.patterns, keyword_frame(spark, banks.crisis, banks.malign), **bounds)


def _dictionary(spark, sf_dir, **bounds):
    rows = stage_results(_accepted(spark, sf_dir), [_dictionary_stage(spark, **bounds)])
    return rows.select("prompt_id", "label", "triggered_by")


def dictionary_rule_stage(spark, sf_dir):
    return _dictionary(spark, sf_dir, max_probe_rows=PROBE_ROWS)


def dictionary_rule_shuffled(spark, sf_dir):
    """The same with a bank too large to travel with the plan or to be broadcast."""
    return _dictionary(spark, sf_dir, max_probe_rows=0, max_broadcast_rows=0)


def severity_enrichment(spark, sf_dir):
    banks = Banks.load()
    return severity(keyword_hits(_whole(spark, sf_dir), banks), banks)


def keyword_bank(spark, sf_dir):
    return reports.keyword_usage(_whole(spark, sf_dir), Banks.load())


def pattern_bank(spark, sf_dir):
    banks = Banks.load()
    return reports.pattern_usage(_whole(spark, sf_dir), banks).select("ord", "id", "pattern", "prompts")


def bank_inventory(spark, sf_dir):
    return reports.bank_inventory(keyword_bank(spark, sf_dir))


# --- model stages -------------------------------------------------------------------------------


def prediction_parse(spark, sf_dir):
    """JSON predictions of every shape, well-formed or not."""
    raw = seeds.documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("prompt_id"),
        F.expr(
            f"""CASE doc_id % 12
            WHEN 0 THEN '[]'
            WHEN 1 THEN '{{"label": "LABEL_1", "score": 0.9}}'
            WHEN 2 THEN '[{{"score": 0.9}}]'
            WHEN 3 THEN '[{{"label": "LABEL_1"}}]'
            WHEN 4 THEN '[{{"label": 7, "score": 0.9}}]'
            WHEN 5 THEN '[{{"label": "LABEL_1", "score": "high"}}]'
            WHEN 6 THEN '[{{"label": "toxic", "score": "0.5"}}]'
            WHEN 7 THEN '[{{"label": "toxic", "score": true}}]'
            WHEN 8 THEN 'oops'
            ELSE '[{{"label": "' || {seeds.CLINICAL_LABEL} || '", "score": '
                 || CAST({seeds.CLINICAL_SCORE} AS STRING) || '}}, {{"label": "second"}}]' END"""
        ).alias("preds"),
    )
    parsed = raw.select("prompt_id", parse_json(F.col("preds")).alias("p"))
    return parsed.select(
        "prompt_id", "p.label", "p.score", F.col("p.error_type").isNotNull().alias("failed")
    )


def label_normalise(spark, sf_dir):
    raw = F.col("raw_label")
    return _raw_predictions(spark, sf_dir).select(
        "prompt_id",
        "raw_label",
        normalise_label(raw, CLINICAL_LABELS).alias("clinical"),
        normalise_label(raw, INJECTION_LABELS).alias("injection"),
    )


def threshold_gate(spark, sf_dir):
    mapped = normalise_label(F.col("raw_label"), CLINICAL_LABELS)
    scored = _raw_predictions(spark, sf_dir).withColumn("mapped", mapped)
    gates = {f"at_{int(t * 100)}": gate(F.col("mapped"), F.col("score"), t) for t in (0.5, 0.75, 0.85)}
    return scored.select("prompt_id", "mapped", "score", *[c.alias(n) for n, c in gates.items()])


def score_guard(spark, sf_dir):
    """Scores below 0, above 1 and NaN are stage errors, hence Server Error verdicts."""
    odd = f"""array(named_struct('label', {seeds.CLINICAL_LABEL}, 'score', CASE doc_id % 6
        WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST(-0.01 AS DOUBLE)
        WHEN 2 THEN CAST(1.01 AS DOUBLE) WHEN 3 THEN CAST(1 AS DOUBLE)
        WHEN 4 THEN CAST(0 AS DOUBLE) ELSE {seeds.CLINICAL_SCORE} END))"""
    prompts = _accepted(spark, sf_dir, clinical=odd)
    return verdicts.flat(screen(prompts, [_clinical_stage()])).select(
        "prompt_id", "code", "label", "score", "reason"
    )


def _stage_rows(rows):
    return rows.select(
        "prompt_id",
        "stage_name",
        "label",
        "confidence",
        "triggered_by",
        "short_circuit",
        F.col("error.type").alias("error_type"),
    )


def semantic_rows(spark, sf_dir):
    return _stage_rows(stage_results(_predicted(spark, sf_dir), [_clinical_stage()]))


def attack_rows(spark, sf_dir):
    return _stage_rows(stage_results(_predicted(spark, sf_dir), [_attack_stage()]))


def _classified(spark, sf_dir, factory, timeout_s=60.0):
    ship(spark)
    source = from_classifier(factory, CLINICAL_MODEL, timeout_s)
    stage = semantic_stage(CLINICAL_MODEL, 0.4, predictions=source)
    return _stage_rows(stage_results(_accepted(spark, sf_dir), [stage]))


def score_text(spark, sf_dir):
    return _classified(spark, sf_dir, seeds.LetterClassifier)


def scorer_errors(spark, sf_dir):
    return _classified(spark, sf_dir, seeds.BrittleClassifier)


def scorer_timeout(spark, sf_dir):
    return _classified(spark, sf_dir, seeds.HangingClassifier, 3.0)


def ml_scored(spark, sf_dir):
    """Every document, scored by a word model that is fitted on the labelled ones, saved and loaded."""
    docs = seeds.documents(spark, sf_dir)
    labelled = docs.join(seeds.table(spark, sf_dir, "labels"), "doc_id").select("text", "toxic")
    path = shared_dir(spark, "word-model")
    fit_words(labelled, "toxic").save(path)
    prompts = seeds.prompts_of(docs, "text").where(F.col("text").isNotNull())
    stage = semantic_stage(CLINICAL_MODEL, 0.75, predictions=from_saved_model(path))
    rows = stage_results(prompts, [stage])
    return rows.select("prompt_id", "label", "triggered_by", F.round("confidence", 6).alias("score"))


# --- chains -------------------------------------------------------------------------------------

_FLAT = ("prompt_id", "code", "label", "stage", "triggered_by", "reason", "score", "processed_text")


def profile_default(spark, sf_dir):
    """The flagship: every text table, validated, rule-screened, one verdict each."""
    prompts = intake.accepted(seeds.all_prompts(spark, sf_dir))
    return verdicts.flat(screen(prompts, build("default")), "source").select(
        "prompt_id", "source", "code", "label", "stage", "triggered_by", "score"
    )


def profile_clinical(spark, sf_dir):
    stages = build(
        "clinical",
        overrides={"stages.1.model_id": CLINICAL_MODEL, "stages.1.threshold": 0.9},
        inject={"semantic_bert": {"predictions": from_column("clinical")}},
    )
    return verdicts.flat(screen(_predicted(spark, sf_dir), stages)).select(*_FLAT)


def profile_full(spark, sf_dir):
    return verdicts.flat(screen(_predicted(spark, sf_dir), _full_stages())).select(*_FLAT)


def profile_full_scored(spark, sf_dir):
    """The full profile with both classifiers running in Python workers on the survivors."""
    ship(spark)
    stages = build(
        "full",
        overrides={
            "stages.1.model_id": CLINICAL_MODEL,
            "stages.1.threshold": 0.4,
            "stages.2.model_id": INJECTION_STAND_IN,
            "stages.2.threshold": 0.25,
        },
        inject={
            "semantic_bert": {"factory": seeds.LetterClassifier, "timeout_s": 60},
            "attack_detection": {"factory": seeds.InjectionClassifier, "timeout_s": 60},
        },
    )
    return verdicts.flat(screen(_accepted(spark, sf_dir), stages)).select(*_FLAT)


def short_circuit_rows(spark, sf_dir):
    """Which stages ran for each prompt: none after a blocking result or an error."""
    rows = stage_results(_predicted(spark, sf_dir), _full_stages())
    return rows.select(
        "prompt_id", "ord", "stage_name", "label", F.col("error").isNotNull().alias("failed")
    )


def _non_blocking_stages() -> list:
    """Stages that flag without stopping the chain, so that the merge has work to do."""

    def column(name, label, score):
        return ColumnStage(
            name,
            lambda df: F.struct(
                F.expr(label).alias("label"),
                F.expr(score).alias("confidence"),
                F.lit("").alias("triggered_by"),
                F.lit(False).alias("short_circuit"),
            ),
        )

    number = "CAST(prompt_id AS BIGINT)"
    return [
        column("first", f"CASE WHEN {number} % 3 = 0 THEN 'Malign' ELSE 'Valid' END",
               f"CAST({number} % 101 AS DOUBLE) / CAST(100 AS DOUBLE)"),
        column("second", f"CASE {number} % 5 WHEN 0 THEN 'Crisis' WHEN 1 THEN 'Server Error' ELSE 'Valid' END",
               f"CASE WHEN {number} % 31 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"),
        column("third", f"CASE WHEN {number} % 2 = 0 THEN 'Malign' ELSE 'Valid' END", "CAST(0.25 AS DOUBLE)"),
    ]


def merge_wide(spark, sf_dir):
    flat = verdicts.flat(screen(_accepted(spark, sf_dir), _non_blocking_stages()))
    return flat.select("prompt_id", "code", "label", "stage", "triggered_by", "score")


def merge_long(spark, sf_dir):
    rows = stage_results(_accepted(spark, sf_dir), _non_blocking_stages(), short_circuit=False)
    merged = verdicts.merge_long(rows)
    return merged.withColumn("triggered_by", F.nullif("triggered_by", F.lit("")))


def audit_all_stages(spark, sf_dir):
    """What precedence would say if blocking results did not stop the chain."""
    flat = verdicts.flat(screen(_predicted(spark, sf_dir), _full_stages(), short_circuit=False))
    return flat.select("prompt_id", "code", "label", "stage", "triggered_by", "score")


def fail_closed(spark, sf_dir):
    flat = verdicts.flat(screen(_predicted(spark, sf_dir), [_clinical_stage(), RuleStage(Banks.load())]))
    return flat.select(*_FLAT)


def custom_stage(spark, sf_dir):
    """A Python stage of the user's own between the rules and the verdict."""
    ship(spark)

    def shouting(text: str, session_id: str | None) -> dict:
        if session_id == "src7":
            raise RuntimeError("session refused")
        loud = text.count("T") > 8
        return {
            "label": MALIGN if loud else VALID,
            "confidence": min(1.0, text.count("T") / 64),
            "triggered_by": "shouting" if loud else None,
            "short_circuit": loud,
        }

    stages = [RuleStage(Banks.load()), PythonStage("shouting", shouting)]
    return verdicts.flat(screen(_accepted(spark, sf_dir), stages)).select(*_FLAT)


def verdicts_of_source(spark, sf_dir):
    """A question about one source of a verdict table; its filter reaches the scan."""
    return profile_default(spark, sf_dir).where(F.col("source") == "src3")


def prediction_table(spark, sf_dir):
    """Predictions that come as a table: given labels stand for a classifier's output, and a prompt
    without one is a stage error."""
    given = seeds.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("prompt_id"),
        F.array(
            F.struct(F.when(F.col("toxic") == 1, "toxic").otherwise("safe").alias("label"), F.lit(0.9).alias("score"))
        ).alias("preds"),
    )
    joined = attach_predictions(_accepted(spark, sf_dir), given, "preds")
    stage = semantic_stage(CLINICAL_MODEL, 0.75, predictions=from_column("preds"))
    rows = stage_results(joined, [stage])
    return rows.select("prompt_id", "label", F.col("error").isNotNull().alias("failed"))


# --- sinks and traces ---------------------------------------------------------------------------


def verdict_json(spark, sf_dir):
    prompts = intake.accepted(seeds.turn_prompts(spark, sf_dir))
    body = verdicts.as_json(screen(prompts, build("default")), "session_id")

    def field(path):
        return F.get_json_object("verdict", path)

    return body.select(
        "prompt_id",
        "session_id",
        field("$.code").cast("int").alias("code"),
        field("$.label").alias("label"),
        field("$.data.processed_text").alias("processed_text"),
        field("$.data.confidence_score").cast("double").alias("score"),
        field("$.data.metadata.stage").alias("stage"),
        field("$.data.metadata.triggered_by").alias("triggered_by"),
    )


def trace_flat(spark, sf_dir):
    return tracing.flat_trace(_full_inspected(spark, sf_dir)).drop("duration_ms")


def trace_json(spark, sf_dir):
    """Fields of the inspect body, read back from the JSON."""
    body = tracing.as_json(_full_inspected(spark, sf_dir))

    def field(path):
        return F.get_json_object("inspection", path)

    return body.select(
        "prompt_id",
        field("$.final.code").cast("int").alias("code"),
        field("$.final.label").alias("label"),
        F.json_array_length(field("$.trace")).alias("executed"),
        field("$.trace[0].label").alias("first_label"),
        field("$.total_stages").cast("int").alias("total_stages"),
    )


def skipped_stages(spark, sf_dir):
    return tracing.flat_skipped(_full_inspected(spark, sf_dir))


def fail_closed_trace(spark, sf_dir):
    prompts = _predicted(spark, sf_dir)
    inspected = inspect(prompts, [_attack_stage(0.75), _clinical_stage(), _attack_stage(0.85)])
    return inspected.select(
        "prompt_id",
        "code",
        F.size("trace").alias("executed"),
        F.array_join("skipped_stages", ",").alias("skipped"),
        "total_stages",
    )


def stage_timing(spark, sf_dir):
    """Row counts of the timed and untimed stages; the times themselves differ per run."""
    ship(spark)
    source = from_classifier(seeds.LetterClassifier, CLINICAL_MODEL, 60.0)
    stages = [RuleStage(Banks.load()), semantic_stage(CLINICAL_MODEL, 0.4, predictions=source)]
    timing = reports.stage_timing(inspect(_accepted(spark, sf_dir), stages))
    measured = (F.col("total_ms") >= F.col("max_ms")).alias("measured")
    return timing.select("stage", "executed", "timed", measured)


# --- reports ------------------------------------------------------------------------------------


def verdict_rollup(spark, sf_dir):
    return reports.verdict_rollup(profile_default(spark, sf_dir))


def verdict_counts(spark, sf_dir):
    return reports.verdict_counts(profile_default(spark, sf_dir))


def stage_funnel(spark, sf_dir):
    return reports.stage_funnel(_full_inspected(spark, sf_dir))


def observed_funnel(spark, sf_dir):
    """The same counts, met in passing while the verdicts are written."""
    stages = _full_stages()
    verdict_table, seen = screen_observed(_predicted(spark, sf_dir), stages)
    verdict_table.write.parquet(shared_dir(spark, "verdicts"))
    return reports.observed_funnel(spark, stages, seen.get).drop("stage_ms")


def top_triggers(spark, sf_dir):
    prompts = intake.accepted(seeds.all_prompts(spark, sf_dir))
    return reports.top_triggers(screen(prompts, build("default")), 10)


def length_profile(spark, sf_dir):
    return reports.length_profile(screen(_predicted(spark, sf_dir), _full_stages()))


def unmapped_labels(spark, sf_dir):
    return reports.unmapped_labels(_raw_predictions(spark, sf_dir), CLINICAL_LABELS)


def gate_report(spark, sf_dir):
    return reports.gate_report(_raw_predictions(spark, sf_dir), CLINICAL_LABELS, 0.75)


# --- streaming ----------------------------------------------------------------------------------


def _document_stream(spark, sf_dir, text):
    """The documents file as a stream, shaped like :func:`seeds.document_prompts`."""
    schema = seeds.table(spark, sf_dir, "documents").schema
    # A glob takes the table as one file or as a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/documents.parque[t]")
    return seeds.prompts_of(stream, text)


def stream_screen(spark, sf_dir):
    stream = _document_stream(spark, sf_dir, seeds.DOCUMENT_TEXT)
    done = jobs.screen_to_table(stream, build("default"))
    return verdicts.flat(done).select("prompt_id", "code", "label", "stage", "triggered_by", "score")


def stream_dictionary(spark, sf_dir):
    """The dictionary stage over a stream."""
    stream = _document_stream(spark, sf_dir, seeds.DOCUMENT_TEXT)
    done = jobs.screen_to_table(stream, [_dictionary_stage(spark)])
    return verdicts.flat(done).select("prompt_id", "code", "label", "stage", "triggered_by", "score")


def stream_rejects(spark, sf_dir):
    stream = _document_stream(spark, sf_dir, seeds.RAW_TEXT)
    return jobs.split_to_tables(stream)[1].select("prompt_id", "reject_reason")


def stream_counts(spark, sf_dir):
    stream = _document_stream(spark, sf_dir, seeds.DOCUMENT_TEXT)
    return jobs.count_to_table(stream, build("default"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "profile_default": profile_default,
    "profile_clinical": profile_clinical,
    "profile_full": profile_full,
    "profile_full_scored": profile_full_scored,
    "validate_prompts": validate_prompts,
    "rejected_prompts": rejected_prompts,
    "json_intake": json_intake,
    "correlation_id": correlation_id,
    "keyword_bank": keyword_bank,
    "pattern_bank": pattern_bank,
    "bank_inventory": bank_inventory,
    "pattern_first_hit": pattern_first_hit,
    "pattern_all_hits": pattern_all_hits,
    "pattern_table_hits": pattern_table_hits,
    "pattern_table_first": pattern_table_first,
    "crisis_first_hit": crisis_first_hit,
    "malign_first_hit": malign_first_hit,
    "keyword_all_hits": keyword_all_hits,
    "keyword_ngram_join": keyword_ngram_join,
    "rule_stage": rule_stage,
    "dictionary_odd_keywords": dictionary_odd_keywords,
    "dictionary_rule_stage": dictionary_rule_stage,
    "dictionary_rule_shuffled": dictionary_rule_shuffled,
    "severity_enrichment": severity_enrichment,
    "prediction_parse": prediction_parse,
    "label_normalise": label_normalise,
    "threshold_gate": threshold_gate,
    "score_guard": score_guard,
    "semantic_stage": semantic_rows,
    "attack_stage": attack_rows,
    "ml_scored": ml_scored,
    "score_text": score_text,
    "scorer_errors": scorer_errors,
    "scorer_timeout": scorer_timeout,
    "short_circuit": short_circuit_rows,
    "merge_wide": merge_wide,
    "merge_long": merge_long,
    "audit_all_stages": audit_all_stages,
    "fail_closed": fail_closed,
    "custom_stage": custom_stage,
    "verdict_json": verdict_json,
    "verdicts_of_source": verdicts_of_source,
    "prediction_table": prediction_table,
    "trace_json": trace_json,
    "trace_flat": trace_flat,
    "skipped_stages": skipped_stages,
    "fail_closed_trace": fail_closed_trace,
    "stage_timing": stage_timing,
    "verdict_rollup": verdict_rollup,
    "verdict_counts": verdict_counts,
    "stage_funnel": stage_funnel,
    "observed_funnel": observed_funnel,
    "top_triggers": top_triggers,
    "length_profile": length_profile,
    "unmapped_labels": unmapped_labels,
    "gate_report": gate_report,
    "stream_screen": stream_screen,
    "stream_dictionary": stream_dictionary,
    "stream_rejects": stream_rejects,
    "stream_counts": stream_counts,
}
