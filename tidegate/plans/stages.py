"""Stages: each adds one ``struct<result, error>`` column to the prompts it is asked to run on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.errors import ResourceError
from tidegate.functions.labels import gate, is_blocking, normalise_label, score_out_of_bounds
from tidegate.model import (
    ATTACK_STAGE,
    CLINICAL_LABELS,
    CRISIS,
    INJECTION_LABELS,
    INJECTION_MODEL,
    INJECTION_THRESHOLD,
    LABELS,
    MALIGN,
    RULE_STAGE,
    SEMANTIC_STAGE,
    STAGE_ERROR,
    STAGE_RESULT,
    VALID,
)
from tidegate.operators.dictionary import PROBE_ROWS, entries_if_few, first_keywords_by_join
from tidegate.operators.probe import probed
from tidegate.operators.rules import (
    FOLDED,
    LOWERED,
    first_pattern,
    rule_hit,
    rule_result,
    with_matchable,
)
from tidegate.operators.scoring import PredictionSource, custom_outcomes, from_classifier, from_saved_model
from tidegate.session import BROADCAST_ROWS
from tidegate.sources.banks import Banks, PatternBank

OUTCOME = T.StructType(
    [T.StructField("result", STAGE_RESULT), T.StructField("error", STAGE_ERROR)]
)


class Stage(Protocol):
    """The extension contract: a stable ``name`` and one method.

    ``evaluate`` adds column ``out`` of type ``OUTCOME``, null where ``active`` is false, keeps
    every row and every other column, and reports failures in ``error`` instead of raising.
    """

    name: str

    def evaluate(self, df: DataFrame, active: Column, out: str) -> DataFrame: ...


def outcome(result: Column, error: Column | None = None) -> Column:
    failed = F.lit(None).cast(STAGE_ERROR) if error is None else error
    return F.struct(
        F.when(failed.isNull(), result).alias("result"), failed.alias("error")
    ).cast(OUTCOME)


def stage_error(stage: str, kind: Column | str, message: Column | str) -> Column:
    def lift(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        F.lit(stage).alias("stage"), lift(kind).alias("type"), lift(message).alias("message")
    ).cast(STAGE_ERROR)


def _bounds_error(stage: str, score: Column) -> Column:
    return F.when(
        score.isNull() | score_out_of_bounds(score),
        stage_error(stage, "ValueError", "confidence outside [0, 1]"),
    )


@dataclass(frozen=True)
class RuleStage:
    """Patterns and keyword banks, native expressions only."""

    banks: Banks
    name: str = RULE_STAGE

    def evaluate(self, df: DataFrame, active: Column, out: str) -> DataFrame:
        prepared = with_matchable(df, F.when(active, F.col("text")))
        hit = F.when(F.col(LOWERED).isNotNull(), rule_hit(self.banks))
        found = prepared.withColumn("_hit", hit).drop(LOWERED, FOLDED)
        done = F.when(F.col("_hit").isNotNull(), outcome(rule_result(F.col("_hit"))))
        return found.withColumn(out, done).drop("_hit")


@dataclass(frozen=True)
class DictionaryRuleStage:
    """The rule stage for banks too large for one expression.

    ``keywords`` is a table with ``bank`` (crisis or malign), ``keyword``, ``folded`` and ``words``. Up to
    ``max_probe_rows`` of them travel with the plan and are looked up where each text is: no join, so the
    stage also runs in streams, and what it reads is read once. More are joined, which streams cannot
    do: hits depend on the text alone, so they come back by its SHA-256, and null and repeated prompt
    ids get what their own text says. Texts are matched where they are read; nothing but n-grams is shuffled.
    """

    patterns: PatternBank
    keywords: DataFrame
    name: str = RULE_STAGE
    max_broadcast_rows: int = BROADCAST_ROWS
    max_probe_rows: int = PROBE_ROWS

    def evaluate(self, df: DataFrame, active: Column, out: str) -> DataFrame:
        found = with_matchable(df.withColumn("_active", active), F.when(active, F.col("text")))
        found = found.withColumn("_pattern", first_pattern(self.patterns))
        entries = entries_if_few(self.keywords, self.max_probe_rows)
        if entries is None:
            found = self._joined(df, active, found.drop(LOWERED, FOLDED))
        else:
            banks = [replace(e, bank=f"_{e.bank}") for e in entries]
            found = probed(found, banks, ("_crisis", "_malign")).drop(LOWERED, FOLDED)

        def hit(label: str, trigger: Column) -> Column:
            return F.struct(F.lit(label).alias("label"), trigger.alias("triggered_by"))

        def keyword(label: str, bank: str) -> Column:
            return hit(label, F.concat(F.lit("keyword:"), F.col(bank)))

        best = (
            F.when(F.col("_pattern").isNotNull(),
                   hit(MALIGN, F.concat(F.lit("bypass:"), F.col("_pattern"))))
            .when(F.col("_crisis").isNotNull(), keyword(CRISIS, "_crisis"))
            .when(F.col("_malign").isNotNull(), keyword(MALIGN, "_malign"))
            .otherwise(hit(VALID, F.lit(None).cast("string")))
        )
        done = F.when(F.col("_active"), outcome(rule_result(best)))
        return found.withColumn(out, done).drop("_active", "_pattern", "_crisis", "_malign")

    def _joined(self, df: DataFrame, active: Column, found: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ResourceError("a bank of this size in a stream: it takes a join by text, which streams cannot do")
        digest = F.sha2(F.col("text").cast("binary"), 256)
        texts = df.where(active).select(digest.alias("_digest"), "text")
        hits = first_keywords_by_join(texts, self.keywords, self.max_broadcast_rows, key="_digest")
        for bank in ("crisis", "malign"):
            first = F.col(bank) if bank in hits.columns else F.lit(None).cast("string")
            hits = hits.withColumn(f"_{bank}", first).drop(bank)
        return found.withColumn("_digest", digest).join(hits, "_digest", "left").drop("_digest")


@dataclass(frozen=True)
class ModelStage:
    """Normalise and gate a text classifier's prediction."""

    name: str
    model_id: str
    threshold: float
    labels: Mapping[str, str]
    predictions: PredictionSource

    def evaluate(self, df: DataFrame, active: Column, out: str) -> DataFrame:
        scored, prediction = self.predictions(df, F.when(active, F.col("text")))
        scored = scored.withColumn("_scored", prediction)
        done = F.when(active, model_outcome(F.col("_scored"), self))
        return scored.withColumn(out, done).drop("_scored", "_ml_out")


def model_outcome(scored: Column, stage: ModelStage) -> Column:
    """Map, gate and bound-check one ``SCORED`` struct.

    The trigger names model and raw label even for Valid, and a downgraded result keeps both.
    """
    raw, score = scored["label"], scored["score"]
    failure = F.when(
        scored["error_type"].isNotNull(),
        stage_error(stage.name, scored["error_type"], scored["error_message"]),
    )
    label = gate(normalise_label(raw, stage.labels), score, stage.threshold)
    result = F.struct(
        F.lit(stage.name).alias("stage_name"),
        label.alias("label"),
        score.alias("confidence"),
        F.concat(F.lit(f"model:{stage.model_id}|raw_label:"), raw).alias("triggered_by"),
        is_blocking(label).alias("short_circuit"),
        scored["duration_ms"].alias("duration_ms"),
    ).cast(STAGE_RESULT)
    return outcome(result, F.coalesce(failure, _bounds_error(stage.name, score)))


@dataclass(frozen=True)
class ColumnStage:
    """A custom stage written as column expressions.

    ``result`` maps the frame to a struct with at least label, confidence, triggered_by and
    short_circuit; a confidence outside [0, 1] or an unknown label is a stage error.
    """

    name: str
    result: Callable[[DataFrame], Column]

    def evaluate(self, df: DataFrame, active: Column, out: str) -> DataFrame:
        made = df.withColumn("_made", F.when(active, self.result(df)))
        done = F.when(F.col("_made").isNotNull(), _custom_outcome(self.name, F.col("_made")))
        return made.withColumn(out, done).drop("_made")


@dataclass(frozen=True)
class PythonStage:
    """A custom stage written as a Python function of one prompt, run in Arrow batches."""

    name: str
    process: Callable[[str, str | None], dict] = field(repr=False)

    def evaluate(self, df: DataFrame, active: Column, out: str) -> DataFrame:
        run = custom_outcomes(self.process)
        prompt = F.struct(F.when(active, F.col("text")).alias("text"), F.col("session_id"))
        made = df.withColumn("_made", run(prompt))
        failure = F.when(
            F.col("_made.error_type").isNotNull(),
            stage_error(self.name, F.col("_made.error_type"), F.col("_made.error_message")),
        )
        done = _custom_outcome(self.name, F.col("_made"), failure, F.col("_made.duration_ms"))
        return made.withColumn(out, F.when(active, done)).drop("_made")


def _custom_outcome(stage: str, made: Column, failure: Column | None = None,
                    duration: Column | None = None) -> Column:
    unknown = F.when(
        made["label"].isNull() | ~made["label"].isin(*LABELS),
        stage_error(stage, "ValueError", "unknown label"),
    )
    result = F.struct(
        F.lit(stage).alias("stage_name"),
        made["label"].alias("label"),
        made["confidence"].alias("confidence"),
        made["triggered_by"].alias("triggered_by"),
        F.coalesce(made["short_circuit"], F.lit(False)).alias("short_circuit"),
        (F.lit(None) if duration is None else duration).cast("double").alias("duration_ms"),
    ).cast(STAGE_RESULT)
    errors = [e for e in (failure, unknown, _bounds_error(stage, made["confidence"])) if e is not None]
    return outcome(result, F.coalesce(*errors))


# --- factories for profiles ---------------------------------------------------------------------


def rule_stage(crisis: str | None = None, malign: str | None = None,
               patterns: str | None = None) -> RuleStage:
    banks = Banks.load(crisis, malign, patterns)
    if (spark := SparkSession.getActiveSession()) is not None and patterns is not None:
        banks.patterns.verify(spark)  # the user's own patterns, before any real job
    return RuleStage(banks)


def semantic_stage(model_id: str, threshold: float, timeout_s: float | None = 10,
                   labels: Mapping[str, str] | None = None,
                   predictions: PredictionSource | None = None, factory=None) -> ModelStage:
    return _model_stage(
        SEMANTIC_STAGE, model_id, threshold, timeout_s, labels or CLINICAL_LABELS, predictions, factory
    )


def attack_stage(model_id: str = INJECTION_MODEL, threshold: float = INJECTION_THRESHOLD,
                 timeout_s: float | None = 10, predictions: PredictionSource | None = None,
                 factory=None) -> ModelStage:
    return _model_stage(
        ATTACK_STAGE, model_id, threshold, timeout_s, INJECTION_LABELS, predictions, factory
    )


def _model_stage(name, model_id, threshold, timeout_s, labels, predictions, factory) -> ModelStage:
    if wrong := sorted(set(labels.values()) - set(LABELS)):
        raise ValueError(f"{name}: labels map to {wrong}, which are none of {list(LABELS)}")
    if predictions is None and factory is not None:
        predictions = from_classifier(factory, model_id, timeout_s)
    if predictions is None:  # the model is one that Spark ML saved, or the stage cannot be built
        predictions = from_saved_model(model_id)
    return ModelStage(name, model_id, float(threshold), dict(labels), predictions)
