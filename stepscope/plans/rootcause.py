"""One root cause per run: the earliest sign, the more reliable one on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift_category(drift: Column) -> Column:
    """Tag of a drift verdict, from its signals, else from words of its reasons."""
    signals = drift["triggered_signals"]
    planned = (
        F.array_contains(signals, "REPEATED_STALLED_SUBGOALS")
        | F.array_contains(signals, "ACCUMULATED_SUBGOAL_FAILURES")
        | F.array_contains(signals, "SLOW_PROGRESS_RATIO")
    )
    why = F.lower(F.array_join(drift["reasons"], " "))
    return (
        F.when(F.array_contains(signals, "PATTERN_REPETITION_DRIFT"), "reflection_error")
        .when(planned, "planning_error")
        .when(why.contains("tool"), "tool_use_error")
        .when(why.contains("memory"), "memory_error")
        .when(why.contains("reflection"), "reflection_error")
        .otherwise("planning_error")
    )


def reflection_category(reflection: Column) -> Column:
    text = F.lower(
        F.concat_ws(
            " ",
            F.array_join(reflection["evidence_sources"], " "),
            reflection["revision_reasoning"],
        )
    )
    return (
        F.when(text.contains("planning") | text.contains("goal"), "planning_error")
        .when(text.contains("reflection") | text.contains("feedback"), "reflection_error")
        .when(text.contains("memory") | text.contains("forgot"), "memory_error")
        .when(text.contains("tool"), "tool_use_error")
        .otherwise("planning_error")
    )


def tiers(checked: DataFrame) -> list[Column]:
    """Aggregates c1, c2, ... of a run: the earliest candidate of each tier.

    `checked` may lack `drift` or `reflection`; then those tiers are left out.
    """
    def candidate(hit: Column, tier: int, category: Column, source: str) -> Column:
        return F.min(
            F.when(
                hit,
                F.struct(
                    F.col("step_index").alias("step"),
                    F.lit(tier).alias("tier"),
                    category.alias("category"),
                    F.lit(source).alias("source"),
                ),
            )
        )

    match = F.col("match")
    found = [candidate(match.isNotNull(), 1, match["category"], "pattern_match").alias("c1")]
    if "drift" in checked.columns:
        drift = F.col("drift")
        drifted = drift["drift_detected"] | match.isNotNull()
        found.append(candidate(drifted, 2, drift_category(drift), "drift_monitor").alias("c2"))
    if "reflection" in checked.columns:
        reflection = F.col("reflection")
        found.append(
            candidate(
                reflection["revision_suggested"], 3, reflection_category(reflection), "reflector"
            ).alias("c3")
        )
    return found


def settled(found: DataFrame) -> dict[str, Column]:
    """The root cause columns from the aggregates of `tiers`."""
    names = [c for c in ("c1", "c2", "c3") if c in found.columns]
    best = F.array_min(F.array_compact(F.array(*names))) if len(names) > 1 else F.col("c1")
    return {
        "root_cause_step_index": best["step"],
        "root_cause_error_type": best["category"],
        "root_cause_source": F.coalesce(best["source"], F.lit("none")),
    }


def root_cause(checked: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Earliest match, drift or revision per run; runs without any get source `none`.

    All tiers come from one pass: a minimum per run, combined before the shuffle.
    """
    found = checked.groupBy("run_id").agg(*tiers(checked))
    if runs is not None:
        found = runs.select("run_id").join(found, "run_id", "left")
    return found.select("run_id", *[c.alias(name) for name, c in settled(found).items()])
