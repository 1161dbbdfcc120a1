"""Reports at subgoal boundaries and at the end of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepscope.plans import drift, reflection, rootcause, tracking


def boundary_report(assessed: DataFrame, threshold: float = 0.35) -> DataFrame:
    """One row per subgoal that ended at a step: passed or not, what comes next.

    Drift and reflection are judged anew after the step, with one more step counted.
    """
    at = assessed.where(F.col("transition").isNotNull())
    state = F.col("state")
    judged = at.withColumn(
        "boundary_drift",
        drift.from_state(
            state, F.col("step_index") + 2, F.col("matches_so_far"), F.col("step_index") + 1,
            threshold,
        ),
    ).withColumn(
        "boundary_reflection",
        reflection.reflect(
            F.lit("subgoal_boundary"), F.col("step_index") + 1,
            state["failed_subgoals_count"], state["stalled_advanced_subgoals_count"],
            state["current_subgoal_id"], F.col("boundary_drift"),
            F.lit(None).cast("struct<confidence:double,category:string>"),
        ),
    )
    return judged.select(
        "run_id",
        "step_index",
        F.col("transition.no").alias("subgoal_no"),
        F.col("transition.status").alias("subgoal_status"),
        F.col("transition.status").isin("completed", "stalled_advanced").alias("checkpoint_passed"),
        state["current_subgoal_id"].alias("next_subgoal"),
        "boundary_drift",
        "boundary_reflection",
    )


def run_flags(checked: DataFrame) -> DataFrame:
    """All matches of all runs, one row each, so that a run may have any number of them."""
    return checked.where(F.col("match").isNotNull()).select("run_id", "step_index", "match.*")


def run_summary(
    checked: DataFrame,
    tracked: DataFrame,
    runs: DataFrame | None = None,
    threshold: float = 0.35,
    legacy_run_end: bool = False,
) -> DataFrame:
    """One row per run: counts, subgoal totals, final drift and reflection, root cause.

    Counts and root cause are aggregates of one pass over the checked steps.

    With `legacy_run_end` the last reflection sees no counters and never revises.
    The flags themselves are in `run_flags`.
    """
    counts = checked.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_steps"),
        F.count_if(F.col("match").isNotNull()).cast("int").alias("n_matches"),
        F.count_if("flagged").cast("int").alias("n_flagged"),
        F.max("step_index").alias("_last"),
        *rootcause.tiers(checked),
    )
    counts = counts.withColumns(rootcause.settled(counts)).drop("c1", "c2", "c3")
    base = counts if runs is None else runs.select("run_id").join(counts, "run_id", "left")
    joined = (
        base.join(tracking.finalize(tracked), "run_id", "left").na.fill(
            0,
            ["total_steps", "n_matches", "n_flagged", "total_subgoals", "completed_count",
             "stalled_advanced_count", "failed_count", "abandoned_count"],
        )
    )
    zero = F.lit(0)
    seen = drift.final(joined, threshold)
    ended = seen.withColumn(
        "final_reflection",
        reflection.reflect(
            F.lit("run_end"), F.coalesce("_last", zero),
            zero if legacy_run_end else F.col("failed_count"),
            zero if legacy_run_end else F.col("stalled_advanced_count"),
            F.lit("final"),
            F.lit(None).cast(drift.DRIFT) if legacy_run_end else F.col("final_drift"),
            F.lit(None).cast("struct<confidence:double,category:string>"),
        ),
    )
    late = (
        F.coalesce("root_cause_source", F.lit("none")).eqNullSafe("none")
        & F.col("final_reflection.revision_suggested")
        & (F.col("total_steps") > 0)
    )
    return ended.select(
        "run_id", "total_steps", "n_matches", "n_flagged",
        "total_subgoals", "completed_count", "stalled_advanced_count", "failed_count",
        "abandoned_count", "is_fallback", "final_drift", "final_reflection",
        F.when(late, F.col("_last")).otherwise(F.col("root_cause_step_index")).alias(
            "root_cause_step_index"
        ),
        F.when(late, rootcause.reflection_category(F.col("final_reflection")))
        .otherwise(F.col("root_cause_error_type"))
        .alias("root_cause_error_type"),
        F.when(late, "reflector")
        .otherwise(F.coalesce("root_cause_source", F.lit("none")))
        .alias("root_cause_source"),
    )
