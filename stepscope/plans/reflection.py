"""When a plan is looked at again, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope.functions import text as tt
from stepscope.operators import ordered


def trigger_type(step_index: Column, at_boundary: Column, interval: int = 5) -> Column:
    """`subgoal_boundary` at a transition, else `step_interval` every few steps, else null."""
    every = max(1, interval)
    return F.when(at_boundary, "subgoal_boundary").when(
        (step_index > 0) & (step_index % every == 0), "step_interval"
    )


def reflection_triggers(
    steps: DataFrame, transitions: DataFrame, interval: int = 5
) -> DataFrame:
    """(run_id, step_index, trigger_type), at most one row per step."""
    timed = steps.where(
        (F.col("step_index") > 0) & (F.col("step_index") % max(1, interval) == 0)
    ).select("run_id", "step_index", F.lit(1).alias("_rank"), F.lit("step_interval").alias("trigger_type"))
    edges = transitions.select(
        "run_id", "step_index", F.lit(0).alias("_rank"), F.lit("subgoal_boundary").alias("trigger_type")
    )
    return ordered.first_by(
        timed.unionByName(edges), ["run_id", "step_index"], [F.col("_rank")]
    ).drop("_rank")


def reflect(
    trigger: Column,
    step_index: Column,
    failed: Column,
    stalled: Column,
    subgoal_id: Column,
    drift: Column,
    match: Column,
) -> Column:
    """Reflection struct; without a trigger the plan is taken as valid and not judged."""
    severe = (
        drift["severity_level"].isin("high", "critical")
        | (drift["severity_score"] >= 0.60)
        | (drift["drift_detected"] & (stalled + failed >= 1))
    )
    caught = (match["confidence"] >= 0.40) & match["category"].isin(
        "planning_error", "reflection_error"
    )
    reasons = F.array_compact(
        F.array(
            F.when(
                failed >= 2,
                F.format_string(
                    "%d subgoals failed explicitly (active: '%s')",
                    failed, F.coalesce(subgoal_id, F.lit("None")),
                ),
            ),
            F.when(
                stalled >= 2,
                F.format_string(
                    "%d subgoal(s) force-advanced due to step limit stalls", stalled
                ),
            ),
            F.when(
                severe,
                F.format_string(
                    "Drift monitor severity high (%.2f, signals: %s)",
                    drift["severity_score"], F.array_join(drift["triggered_signals"], ","),
                ),
            ),
            F.when(
                caught,
                F.format_string(
                    "Step check flagged severe %s pattern (confidence=%.2f)",
                    match["category"], match["confidence"],
                ),
            ),
        )
    )
    evidence = F.array_compact(
        F.array(
            F.lit("subgoals"),
            F.lit("drift_monitor"),
            F.when(match.isNotNull(), F.lit("step_check")),
        )
    )
    head = F.concat(
        F.lit("Plan re-evaluation at step "), step_index.cast("string"),
        F.lit(" ("), trigger, F.lit("): "),
    )

    def build(why: Column) -> Column:
        bad = F.size(why) > 0
        return F.struct(
            (~bad).alias("plan_still_valid"),
            bad.alias("revision_suggested"),
            F.when(
                bad,
                F.concat(
                    head, F.array_join(why, "; "),
                    F.lit(". Original plan strategy is no longer optimal "
                          "— revision recommended."),
                ),
            )
            .otherwise(
                F.concat(head, F.lit("Original plan remains valid and achievable."))
            )
            .alias("revision_reasoning"),
            F.when(bad, F.round(F.least(F.lit(0.95), 0.5 + F.size(why) * 0.2), 2))
            .otherwise(0.85)
            .alias("confidence"),
            trigger.alias("trigger_type"),
            evidence.alias("evidence_sources"),
        )

    # Reasons are put together where there is a trigger only: most steps have none.
    return F.when(trigger.isNotNull(), tt.let(reasons, build)).otherwise(
        F.struct(
            F.lit(True).alias("plan_still_valid"),
            F.lit(False).alias("revision_suggested"),
            F.lit("").alias("revision_reasoning"),
            F.lit(1.0).alias("confidence"),
            F.lit("step_interval").alias("trigger_type"),
            F.expr("cast(array() as array<string>)").alias("evidence_sources"),
        )
    )
