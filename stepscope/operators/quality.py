"""Contamination audit, noise split and duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.functions import text as tt
from stepscope.operators import ordered

_STEP_TEXT = ["reasoning", "action_name", "args_key", "tool_response"]
_RUN_TEXT = ["run_id", "task_id", "task_description", "grader_notes"]


def _marked(df: DataFrame, columns: list[str], markers: list[str], code: str | None) -> Column:
    hit = F.lit(False)
    for name in columns:
        if name in df.columns:
            low = F.lower(F.col(name).cast("string"))
            hit = hit | tt.contains_any(low, [m.lower() for m in markers])
            if code:
                hit = hit | F.coalesce(low.rlike(rf"\b{code}\b"), F.lit(False))
    return hit


def _step_facts(steps: DataFrame, markers: list[str], code: str | None) -> DataFrame:
    unknown = F.lower("action_name") == "unknown"
    failed = F.lower("action_name") == "error"
    return steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.bool_or(_marked(steps, _STEP_TEXT, markers, code)).alias("step_marked"),
        F.bool_or(F.coalesce(unknown, F.lit(False))).alias("unknown_action"),
        F.bool_or(F.coalesce(failed, F.lit(False))).alias("error_action"),
    )


def audit_runs(
    runs: DataFrame,
    steps: DataFrame,
    markers: list[str] | None = None,
    code: str | None = "429",
) -> DataFrame:
    """One row per run with `contaminated`.

    A run is contaminated when a marker occurs in its texts, an action is
    `unknown`, or it ended in error with a recorded but empty step list.
    """
    markers = tx.CONTAMINATION_MARKERS if markers is None else markers
    facts = _step_facts(steps, markers, code)
    has_list = F.col("has_trajectory") if "has_trajectory" in runs.columns else F.lit(True)
    joined = runs.join(facts, "run_id", "left")
    bad = (
        _marked(runs, _RUN_TEXT, markers, code)
        | F.coalesce("step_marked", F.lit(False))
        | F.coalesce("unknown_action", F.lit(False))
        | ((F.col("final_status") == "error") & has_list & F.col("n_steps").isNull())
    )
    return joined.withColumn("contaminated", F.coalesce(bad, F.lit(False))).select(
        *runs.columns, F.coalesce("n_steps", F.lit(0)).alias("n_steps"), "contaminated"
    )


def audit_report(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.count_if("contaminated").alias("contaminated_count"),
        F.count_if(~F.col("contaminated")).alias("clean_count"),
    )


def split_infra_noise(
    runs: DataFrame,
    steps: DataFrame,
    markers: list[str] | None = None,
    code: str | None = "429",
) -> DataFrame:
    """Add `infra_noise`: rate-limit text, error without steps, or one `error` action."""
    markers = tx.RATE_LIMIT_MARKERS if markers is None else markers
    facts = _step_facts(steps, markers, code)
    joined = runs.join(facts, "run_id", "left")
    total = (
        F.col("total_steps_taken")
        if "total_steps_taken" in runs.columns
        else F.coalesce("n_steps", F.lit(0))
    )
    noise = (
        _marked(runs, _RUN_TEXT, markers, code)
        | F.coalesce("step_marked", F.lit(False))
        | ((F.col("final_status") == "error") & F.col("n_steps").isNull())
        | ((total == 1) & F.coalesce("error_action", F.lit(False)))
    )
    return joined.withColumn("infra_noise", F.coalesce(noise, F.lit(False))).select(
        *runs.columns, "infra_noise"
    )


def dedupe_runs(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in path order."""
    return ordered.first_by(runs, keys, [F.col(c) for c in order])


def flag_corrupted_action(
    truth: DataFrame, steps: DataFrame, stopwords: list[str] | None = None
) -> DataFrame:
    """Add `suspected_corrupted_action` to truth(run_id, root_cause_step_index)."""
    words = tx.STOPWORD_ACTIONS if stopwords is None else stopwords
    at = steps.select(
        F.col("run_id").alias("_run"),
        F.col("step_index").alias("_step"),
        F.lower(tt.strip(F.coalesce("action_name", F.lit("")))).isin(*words).alias("_stop"),
    )
    return (
        truth.join(
            at,
            (F.col("run_id") == F.col("_run"))
            & (F.col("root_cause_step_index") == F.col("_step")),
            "left",
        )
        .withColumn("suspected_corrupted_action", F.coalesce("_stop", F.lit(False)))
        .drop("_run", "_step", "_stop")
    )
