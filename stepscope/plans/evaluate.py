"""Offline replay of whole runs: plan check, step check, run summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepscope.config import Settings
from stepscope.operators import detectors, vectors
from stepscope.plans import checks, summary, tracking
from stepscope.session import cut


@dataclass(frozen=True)
class Evaluation:
    plans: DataFrame
    steps: DataFrame
    flags: DataFrame
    subgoals: DataFrame
    runs: DataFrame


def evaluate_trajectories(
    steps: DataFrame,
    plans: DataFrame,
    settings: Settings | None = None,
    patterns: DataFrame | None = None,
    idf: DataFrame | None = None,
    boundaries: DataFrame | None = None,
    **match_options,
) -> Evaluation:
    """Everything the live guard would have said about finished runs.

    `patterns` and `idf` switch on the pattern layer; without them the word and
    look-back rules work alone.
    """
    settings = settings or Settings()
    near = near_plans = None
    if patterns is not None:
        said = steps.select("run_id", "step_index", F.expr(detectors.STEP_TEXT).alias("text"))
        near = vectors.nearest_pattern(
            said, patterns, idf, ["run_id", "step_index"],
            thresholds=settings.category_thresholds,
            default_threshold=settings.similarity_threshold,
        )
        both = plans.select(
            "run_id", F.concat_ws(" ", "task_description", "proposed_plan").alias("text")
        )
        near_plans = vectors.nearest_pattern(
            both, patterns, idf, ["run_id"], thresholds=settings.category_thresholds,
            default_threshold=settings.similarity_threshold,
        )
    # One small row per run, read three times below.
    tracked = cut(tracking.track(steps, plans, settings.max_subgoal_steps, boundaries))
    checked = detectors.check_steps(
        steps, plans, settings, near=near, tracked=tracked, **match_options
    )
    return Evaluation(
        plans=checks.check_plans(plans, near_plans, settings.block_on_critical),
        steps=checked,
        flags=summary.run_flags(checked),
        subgoals=tracking.final_subgoals(tracked),
        runs=summary.run_summary(checked, tracked, threshold=settings.drift_threshold),
    )
