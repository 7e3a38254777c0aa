"""Model scoring on Spark workers.

A *prediction source* turns a frame and the masked text column into one ``SCORED`` struct per
row. Rows whose text is masked (null) were blocked earlier: they cross to Python as a null and are
never scored, so one pass serves survivors and blocked rows alike, without a second read of the
input, and only the text column is sent to the workers.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.errors import ResourceError
from tidegate.operators.inference import ChunkScorer, failed
from tidegate.model import CUSTOM_OUTCOME, SCORED

PredictionSource = Callable[[DataFrame, Column], tuple[DataFrame, Column]]
CHUNK_ROWS = 32

# Classifiers of a Python worker process, by the token of their prediction source; the last few.
_loaded: dict[str, ChunkScorer] = {}
KEPT_MODELS = 4


# --- predictions that already exist as a column -------------------------------------------------


def _scored(label: Column, score: Column) -> Column:
    bad = label.isNull() | score.isNull()
    return F.struct(
        F.when(~bad, label).alias("label"),
        F.when(~bad, score).alias("score"),
        F.when(bad, F.lit("ValueError")).alias("error_type"),
        F.when(bad, F.lit("unexpected model output")).alias("error_message"),
        F.lit(None).cast("double").alias("duration_ms"),
    ).cast(SCORED)


def parse_array(predictions: Column) -> Column:
    """First element of ``array<struct<label,score>>``; anything incomplete is a stage error."""
    first = F.get(predictions, 0)
    return _scored(first["label"], first["score"].try_cast("double"))


_NUMERAL = r"^\s*[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\s*$"


def parse_json(predictions: Column) -> Column:
    """First element of a JSON list ``[{"label": str, "score": number}]``.

    A label must be a JSON string. A score may also be a boolean or a numeral in a string, as a
    float conversion would allow; null, missing, nested or non-numeric values are stage errors.
    """
    # The one-element transform names the parsed value, so that it is parsed once.
    parsed = F.array(F.try_parse_json(predictions))
    return F.get(F.transform(parsed, _read_variant), 0)


def _read_variant(value: Column) -> Column:
    def field(path: str, kind: str) -> Column:
        return F.try_variant_get(value, path, kind)

    label, score = "$[0].label", "$[0].score"
    label_kind = F.schema_of_variant(field(label, "variant"))
    score_kind = F.schema_of_variant(field(score, "variant"))
    numeral = field(score, "string")
    number = (
        F.when(score_kind == "STRING", F.when(
            numeral.rlike(_NUMERAL), F.translate(F.trim(numeral), "_", "").try_cast("double")))
        .when(score_kind == "BOOLEAN", field(score, "boolean").cast("double"))
        .otherwise(field(score, "double"))
    )
    return _scored(F.when(label_kind == "STRING", field(label, "string")), number)


def from_column(name: str, parser: Callable[[Column], Column] = parse_array) -> PredictionSource:
    """Predictions computed elsewhere and joined in beforehand."""

    def source(df: DataFrame, text: Column) -> tuple[DataFrame, Column]:
        return df, F.when(text.isNotNull(), parser(F.col(name)))

    return source


def attach_predictions(prompts: DataFrame, predictions: DataFrame, name: str) -> DataFrame:
    """Left equi-join of a prediction table (one row per prompt). A prompt without one keeps null
    and becomes a stage error if the stage reaches it."""
    side = predictions.select("prompt_id", F.col("preds").alias(name))
    return prompts.join(side, "prompt_id", "left")


# --- a classifier running in Python workers -----------------------------------------------------


def _scorer(token: str, make: Callable[[], ChunkScorer]) -> ChunkScorer:
    scorer = _loaded.pop(token, None) or make()
    while len(_loaded) >= KEPT_MODELS:
        _loaded.pop(next(iter(_loaded))).end()  # the one not used for longest
    _loaded[token] = scorer
    return scorer


def from_classifier(
    factory: Callable[..., Any],
    model_id: str = "",
    timeout_s: float | None = 10.0,
    chunk_rows: int = CHUNK_ROWS,
) -> PredictionSource:
    """Score with ``factory(task, model=, truncation=)``, a picklable callable.

    The model is loaded on first use, in a child process that each Python worker keeps under a token
    made here, as a function that travels by value is a new object in every task. ``timeout_s`` is for
    one text; a call that overruns is ended with its process. Load failures and scoring failures mark
    rows; they never fail the task.
    """

    token = uuid.uuid4().hex

    def load() -> Any:
        return factory("text-classification", model=model_id, truncation=True)

    def rows_of(texts: list[str]) -> list[tuple]:
        if not texts:
            return []
        try:
            scorer = _scorer(token, lambda: ChunkScorer(load, timeout_s, chunk_rows))
        except Exception as exc:
            return [(*failed(ResourceError(model_id, exc)), None)] * len(texts)
        return scorer.score(texts)

    # Non-deterministic on purpose: the optimizer then never duplicates the call or moves a
    # filter on its output below it, so each surviving prompt is scored once per attempt.
    udf = F.pandas_udf(_masked(rows_of, SCORED.names), SCORED).asNondeterministic()
    return lambda df, text: (df, udf(text))


def _masked(rows_of: Callable[[list], list[tuple]], names: list[str]):
    """Series iterator -> frame iterator that calls ``rows_of`` on the non-null values only."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            live = texts.notna().to_numpy()
            frame = pd.DataFrame(
                {name: pd.Series([None] * len(texts), dtype=object) for name in names}
            )
            done = pd.DataFrame(rows_of(texts[live].tolist()), columns=names, dtype=object)
            frame.loc[live, names] = done.to_numpy()
            for name in ("score", "confidence", "duration_ms"):
                if name in names:
                    frame[name] = frame[name].astype("float64")
            yield frame

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


# --- a fitted Spark ML model --------------------------------------------------------------------


def _stages(model: Any) -> list:
    return [stage for part in model.stages for stage in _stages(part)] if hasattr(model, "stages") else [model]


def _without_summary(model: Any) -> Any:
    """The model, copied without what it knows of its training: that holds a session, which cannot be sent to
    workers once it has observed something."""
    if not any(getattr(stage, "hasSummary", False) for stage in _stages(model)):
        return model
    model = model.copy()
    for stage in _stages(model):
        if getattr(stage, "hasSummary", False) and hasattr(stage, "_java_obj"):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def from_ml_model(
    model: Any,
    raw_labels: tuple[str, ...] = ("LABEL_0", "LABEL_1"),
    input_column: str = "scored_text",
) -> PredictionSource:
    """Score with a fitted Spark ML model, entirely in the JVM.

    The model was fitted on ``input_column`` and writes ``prediction`` and ``probability``; class
    *i* reports ``raw_labels[i]``. Blocked rows are offered as an empty text, which costs nothing.
    """
    from pyspark.ml.functions import vector_to_array

    model = _without_summary(model)

    def source(df: DataFrame, text: Column) -> tuple[DataFrame, Column]:
        offered = df.withColumn("_ml_live", text.isNotNull())
        offered = offered.withColumn(input_column, F.coalesce(text, F.lit("")))
        names = F.array(*[F.lit(label) for label in raw_labels])
        index = F.col("prediction").cast("int")
        best = F.get(vector_to_array("probability"), index)
        out = F.when(F.col("_ml_live"), _scored(F.get(names, index), best))
        scored = model.transform(offered).withColumn("_ml_out", out)
        return scored.select(*df.columns, "_ml_out"), F.col("_ml_out")

    return source


def from_saved_model(path: str, raw_labels: tuple[str, ...] = ("LABEL_0", "LABEL_1")) -> PredictionSource:
    """A pipeline saved by Spark ML, on any path that Spark reads. What cannot be loaded is a build error."""
    from pyspark.ml import PipelineModel

    try:
        model = PipelineModel.load(path)
    except Exception as exc:
        raise ResourceError(f"model {path}", exc) from exc
    return from_ml_model(model, raw_labels)


def fit_words(texts: DataFrame, label: str, most_words: int = 1 << 18, smoothing: float = 1.0) -> Any:
    """A linear text classifier, fitted and applied in the JVM: word counts into multinomial naive Bayes.

    ``texts`` has ``text`` and a 0/1 column. Words are runs of ASCII word characters; of those met, the
    ``most_words`` most frequent are the model's features, so the driver holds two weights for each.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer

    rows = texts.where(F.col("text").isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col("text").alias("scored_text"), F.col(label).cast("double").alias("_ml_label"))
    flow = Pipeline(
        stages=[
            RegexTokenizer(inputCol="scored_text", outputCol="_ml_words", pattern="[^0-9a-z_]+"),
            CountVectorizer(inputCol="_ml_words", outputCol="_ml_counts", vocabSize=most_words),
            NaiveBayes(featuresCol="_ml_counts", labelCol="_ml_label", smoothing=smoothing),
        ]
    )
    return flow.fit(rows)


# --- row-at-a-time custom stages ----------------------------------------------------------------


def _ms(start: float) -> float:
    return round((time.perf_counter() - start) * 1000, 3)


def custom_outcomes(process: Callable[[str, str | None], dict]):
    """``process(text, session_id)`` -> dict with label, confidence, triggered_by, short_circuit.

    Returned as a pandas UDF over a struct of both columns; exceptions become error columns.
    """

    def one(text: str, session_id: str | None) -> tuple:
        start = time.perf_counter()
        try:
            got = process(text, session_id)
            return (
                str(got["label"]),
                float(got["confidence"]),
                got.get("triggered_by"),
                bool(got.get("short_circuit", False)),
                None,
                None,
                _ms(start),
            )
        except Exception as exc:
            return (None, None, None, None, type(exc).__name__, str(exc), _ms(start))

    def run(batches):
        for pdf in batches:
            live = pdf["text"].notna()
            rows = [
                one(text, session if isinstance(session, str) else None) if ok else (None,) * 7
                for text, session, ok in zip(pdf["text"], pdf["session_id"], live)
            ]
            frame = pd.DataFrame(rows, columns=CUSTOM_OUTCOME.names, dtype=object)
            for name in ("confidence", "duration_ms"):
                frame[name] = frame[name].astype("float64")
            yield frame

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, CUSTOM_OUTCOME).asNondeterministic()
