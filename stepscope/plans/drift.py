"""Weighted drift score of a run at each step, at a boundary and at its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.functions import text as tt

DRIFT = (
    "struct<drift_detected:boolean,severity_score:double,severity_level:string,"
    "triggered_signals:array<string>,reasons:array<string>,step_index:int,subgoal_id:string>"
)


def _level(score: Column) -> Column:
    return (
        F.when(score <= 0, "none")
        .when(score < 0.35, "low")
        .when(score < 0.60, "medium")
        .when(score < 0.85, "high")
        .otherwise("critical")
    )


def assess(
    stalled: Column,
    failed: Column,
    ratio: Column,
    steps_in_subgoal: Column,
    total_steps: Column,
    matches: Column,
    subgoal_id: Column,
    step_index: Column,
    threshold: float = 0.35,
) -> Column:
    """Drift struct from counters; four weighted signals."""
    names = list(tx.DRIFT_WEIGHTS)
    fired = [
        stalled >= 2,
        ((total_steps >= 8) & (ratio < 0.20)) | (steps_in_subgoal >= 8),
        (failed >= 2) | (failed + stalled >= 3),
        matches >= 2,
    ]
    why = [
        F.format_string(
            "Repeated stalled subgoals detected: %d subgoals force-advanced after step limit",
            stalled,
        ),
        F.format_string(
            "Slow progress ratio (%.2f after %d total steps, %d steps in active subgoal '%s')",
            ratio, total_steps, steps_in_subgoal, F.coalesce(subgoal_id, F.lit("None")),
        ),
        F.format_string(
            "Accumulated subgoal failures: %d failed, %d stalled-advanced", failed, stalled
        ),
        F.format_string(
            "Pattern repetition drift: %d step flags raised", matches
        ),
    ]
    signals = F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in zip(fired, names)]))
    reasons = F.array_compact(F.array(*[F.when(f, r) for f, r in zip(fired, why)]))
    raw = F.lit(0.0)
    for test, name in zip(fired, names):
        raw = raw + F.when(test, tx.DRIFT_WEIGHTS[name]).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(raw, 3))
    return tt.let(
        score,
        lambda s: F.struct(
            (s >= threshold).alias("drift_detected"),
            s.alias("severity_score"),
            _level(F.when(s >= threshold, s).otherwise(0.0)).alias("severity_level"),
            signals.alias("triggered_signals"),
            reasons.alias("reasons"),
            step_index.cast("int").alias("step_index"),
            subgoal_id.alias("subgoal_id"),
        ),
    )


def from_state(state: Column, total_steps: Column, matches: Column, step_index: Column,
               threshold: float = 0.35) -> Column:
    return assess(
        state["stalled_advanced_subgoals_count"],
        state["failed_subgoals_count"],
        state["subgoal_progress_ratio"],
        state["steps_in_current_subgoal"],
        total_steps,
        matches,
        state["current_subgoal_id"],
        step_index,
        threshold,
    )


def final(runs: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Add the run-end verdict to runs with totals, `total_steps` and `n_matches`.

    At the end progress counts completed subgoals only, and no subgoal is active.
    """
    ratio = F.col("completed_count") / F.greatest("total_subgoals", F.lit(1))
    return runs.withColumn(
        "final_drift",
        assess(
            F.col("stalled_advanced_count"),
            F.col("failed_count"),
            ratio,
            F.lit(0),
            F.col("total_steps"),
            F.col("n_matches"),
            F.lit("final"),
            F.col("total_steps") - 1,
            threshold,
        ),
    )
