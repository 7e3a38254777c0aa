"""Running an ordered stage list over a prompt frame.

Everything stays in one row per prompt: each stage adds a struct column, a boolean says whether
the row is finished, and the merge reads the structs. No shuffle, one read of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegate.functions.plan import computed
from tidegate.model import STAGE_ERROR
from tidegate.operators import trace as tracing
from tidegate.operators.verdict import merge_wide, verdict_columns
from tidegate.plans.stages import Stage

_HALT, _FAIL, _BEST, _TRACE = "_halt", "_fail", "_best", "_trace"


def _out(order: int) -> str:
    return f"_out{order}"


def run_stages(prompts: DataFrame, stages: Sequence[Stage], short_circuit: bool = True) -> DataFrame:
    """Add one outcome column per stage plus the failure, if any.

    A row stops at its first blocking result (the flag decides, not the label) or first error.
    ``short_circuit=False`` lets every stage run unless one fails: the audit view.
    """
    if not stages:
        raise ValueError("at least one stage is required")
    df = prompts.withColumns({_HALT: F.lit(False), _FAIL: F.lit(None).cast(STAGE_ERROR)})
    for order, stage in enumerate(stages):
        df = stage.evaluate(df, ~F.col(_HALT), _out(order))
        df = computed(df, **{_out(order): F.col(_out(order))})
        error = F.col(_out(order))["error"]
        stop = F.col(_HALT) | F.coalesce(error.isNotNull(), F.lit(False))
        if short_circuit:
            stop = stop | F.coalesce(F.col(_out(order))["result"]["short_circuit"], F.lit(False))
        df = df.withColumns({_HALT: stop, _FAIL: F.coalesce(F.col(_FAIL), error)})
    return df


def _results(count: int) -> list[Column]:
    return [F.col(_out(order))["result"] for order in range(count)]


def _passengers(prompts: DataFrame) -> list[str]:
    return [c for c in prompts.columns if c != "text"]


def screen(prompts: DataFrame, stages: Sequence[Stage], short_circuit: bool = True) -> DataFrame:
    """Verdicts: the input columns but ``text``, then ``code``, ``label`` and ``data``."""
    ran = run_stages(prompts, stages, short_circuit)
    ran = ran.withColumn(_BEST, merge_wide(_results(len(stages))))
    verdict = verdict_columns(F.col(_BEST), F.col(_FAIL).isNotNull(), F.col("text"))
    return ran.select(*_passengers(prompts), *verdict)


def screen_observed(
    prompts: DataFrame, stages: Sequence[Stage], short_circuit: bool = True
) -> tuple[DataFrame, Observation]:
    """Verdicts, and what each stage did, counted in passing by the first action on them.

    ``reports.observed_funnel`` reads the counts; asking for them waits for that action. As in the trace, no
    stage counts as executed for a prompt that failed.
    """
    ran = run_stages(prompts, stages, short_circuit)
    ran = ran.withColumn(_BEST, merge_wide(_results(len(stages))))
    counts = []
    for order, result in enumerate(_results(len(stages))):
        error = F.col(_out(order))["error"]
        done = result.isNotNull() & F.col(_FAIL).isNull()
        seen = {
            "executed": F.count_if(done),
            "skipped": F.count_if(~done),
            "blocked": F.count_if(done & F.coalesce(result["short_circuit"], F.lit(False))),
            "failed": F.count_if(F.coalesce(error.isNotNull(), F.lit(False))),
            "stage_ms": F.sum(result["duration_ms"]),
        }
        counts += [column.alias(f"{name}_{order}") for name, column in seen.items()]
    observation = Observation()
    ran = ran.observe(observation, *counts)
    verdict = verdict_columns(F.col(_BEST), F.col(_FAIL).isNotNull(), F.col("text"))
    return ran.select(*_passengers(prompts), *verdict), observation


def inspect(prompts: DataFrame, stages: Sequence[Stage], short_circuit: bool = True) -> DataFrame:
    """Verdicts plus ``trace``, ``skipped_stages``, ``total_stages``, ``total_duration_ms`` and, for
    the reports only, ``failed_stage``."""
    ran = run_stages(prompts, stages, short_circuit)
    results, failed = _results(len(stages)), F.col(_FAIL).isNotNull()
    ran = ran.withColumns({_BEST: merge_wide(results), _TRACE: tracing.trace_array(results, failed)})
    names = [stage.name for stage in stages]
    return ran.select(
        *_passengers(prompts),
        *verdict_columns(F.col(_BEST), failed, F.col("text")),
        F.col(_TRACE).alias("trace"),
        tracing.skipped(names, F.col(_TRACE)).alias("skipped_stages"),
        F.lit(len(names)).alias("total_stages"),
        tracing.total_ms(F.col(_TRACE)).alias("total_duration_ms"),
        F.col(_FAIL)["stage"].alias("failed_stage"),
    )


def stage_results(prompts: DataFrame, stages: Sequence[Stage], short_circuit: bool = True) -> DataFrame:
    """Long form: one row per prompt and stage that ran, successful or failed."""
    ran = run_stages(prompts, stages, short_circuit)
    outs = F.array(*[F.col(_out(order)) for order in range(len(stages))])
    rows = ran.select("prompt_id", F.posexplode(outs).alias("ord", "out"))
    rows = rows.where(F.col("out").isNotNull())
    return rows.select("prompt_id", "ord", "out.result.*", F.col("out.error").alias("error"))
