"""Step detectors: look-back rules and word rules, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.config import Settings
from stepscope.functions import text as tt
from stepscope.operators import ordered
from stepscope.plans import checks, drift, reflection, tracking

NO_EFFECT = "nothing happens"


def _lag_hits(test, depth: int) -> Column:
    """How many of the last `depth` rows pass `test(distance)`."""
    hits = F.lit(0)
    for distance in range(1, depth + 1):
        hits = hits + F.coalesce(test(distance).cast("int"), F.lit(0))
    return hits


def action_key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys])


def repetition_count(window, keys: list[str], lookback: int = 5) -> Column:
    key = action_key(keys)
    hits = _lag_hits(lambda d: F.lag(key, d).over(window) == key, lookback)
    return F.when(F.coalesce("action_name", F.lit("")) != "", hits).otherwise(0)


def no_effect_count(window, phrase: str, lookback: int = 3) -> Column:
    """Earlier no-effect responses, or null when this one has an effect."""
    here = F.coalesce(F.lower("tool_response").contains(phrase), F.lit(False))
    hits = _lag_hits(lambda d: F.lag(here, d).over(window), lookback)
    return F.when(here, hits)


def failing_loop_count(window, keys: list[str], lookback: int = 4) -> Column:
    """Failed actions among the last ones that had this very signature."""
    key = action_key(keys)
    failed_key = F.when(tt.response_failed(F.col("tool_response")), key)
    return _lag_hits(lambda d: F.lag(failed_key, d).over(window) == key, lookback)


def repetition_match(count: Column, lookback: int = 5, minimum: int = 2) -> Column:
    return F.when(
        count >= minimum,
        tt.match_struct(
            "memory_error",
            F.least(F.lit(0.90), F.round(0.50 + count * 0.10, 10)),
            "keyword",
            rule_id="structural_action_repetition",
            description=F.format_string(
                f"Action '%s' repeated %d times in last {lookback} steps",
                F.col("action_name"), count,
            ),
        ),
    )


def no_effect_match(count: Column, lookback: int = 3, minimum: int = 2) -> Column:
    return F.when(
        count >= minimum,
        tt.match_struct(
            "tool_use_error",
            F.least(F.lit(0.85), F.round(0.50 + count * 0.10, 10)),
            "keyword",
            rule_id="structural_nothing_happens_loop",
            description=F.format_string(
                f"'Nothing happens' response %d times in last {lookback + 1} steps", count + 1
            ),
        ),
    )


def action_repetition(
    steps: DataFrame,
    keys: list[str] = ("action_name", "args_key"),
    lookback: int = 5,
    minimum: int = 2,
    block: int = ordered.BLOCK,
) -> DataFrame:
    """Add `repeats` and `match` for actions repeated within the look-back."""
    counted = ordered.neighbours(
        steps, "run_id", "step_index",
        lambda w: {"repeats": repetition_count(w, list(keys), lookback)},
        back=lookback, block=block, keep=True,
    )
    return counted.withColumn("match", repetition_match(F.col("repeats"), lookback, minimum)).drop(
        "_block"
    )


def no_effect_loop(
    steps: DataFrame,
    phrase: str = NO_EFFECT,
    lookback: int = 3,
    minimum: int = 2,
    block: int = ordered.BLOCK,
) -> DataFrame:
    counted = ordered.neighbours(
        steps, "run_id", "step_index",
        lambda w: {"no_effects": no_effect_count(w, phrase, lookback)},
        back=lookback, block=block,
    )
    return counted.withColumn("match", no_effect_match(F.col("no_effects"), lookback, minimum))


def failing_loop_block(
    steps: DataFrame,
    keys: list[str] = ("action_name", "args_key"),
    lookback: int = 4,
    minimum: int = 3,
    block: int = ordered.BLOCK,
) -> DataFrame:
    """Would this action be refused, as the same one kept failing just before?"""
    counted = ordered.neighbours(
        steps, "run_id", "step_index",
        lambda w: {"failed_repeats": failing_loop_count(w, list(keys), lookback)},
        back=lookback, block=block,
    )
    return counted.withColumn("blocked", F.col("failed_repeats") >= minimum)


# What the agent itself wrote; responses are kept out of the vectors.
STEP_TEXT = (
    "concat_ws(' ', coalesce(reasoning, ''), coalesce(action_name, ''), coalesce(args_key, ''))"
)


def match_steps(
    steps: DataFrame,
    tasks: DataFrame | None = None,
    near: DataFrame | None = None,
    keys: list[str] = ("action_name", "args_key"),
    phrase: str = NO_EFFECT,
    rules=None,
    block: int = ordered.BLOCK,
    longs=ordered.LOOK_UP,
) -> DataFrame:
    """Add `match`, the first rule that applies to a step, or null.

    `tasks(run_id, task_description)` enables the plan rules on search actions.
    `near(run_id, step_index, match)` holds pattern matches of the step text. The
    block column stays for the operators that follow.
    """
    base = steps
    if near is not None:
        base = base.join(
            near.select("run_id", "step_index", F.col("match").alias("_near")),
            ["run_id", "step_index"], "left",
        )
    else:
        base = base.withColumn("_near", F.lit(None).cast(tt.MATCH))
    looked = ordered.neighbours(
        base, "run_id", "step_index",
        lambda w: {
            "_repeats": repetition_count(w, list(keys)),
            "_no_effects": no_effect_count(w, phrase),
        },
        back=5, block=block, keep=True,
    )
    if tasks is not None:
        looked = ordered.join_runs(
            looked, tasks.select("run_id", F.col("task_description").alias("_task")),
            block=block, longs=longs,
        )
        search = F.lower("action_name").contains("search") & (F.coalesce("_task", F.lit("")) != "")
        plan = F.concat_ws(" ", "action_name", F.coalesce("args_key", F.lit("")))
        contra = F.when(search, checks.plan_contradiction(F.col("_task"), plan))
        omitted = F.when(search, checks.constraint_omission(F.col("_task"), plan))
    else:
        contra = omitted = F.lit(None).cast(tt.MATCH)
    looked = tt.add_keyword_rule(looked, "_said", STEP_TEXT, rules)
    looked = tt.add_keyword_rule(looked, "_heard", "tool_response", rules)
    return looked.withColumn(
        "match",
        F.coalesce(
            contra,
            F.col("_near"),
            F.col("_said"),
            repetition_match(F.col("_repeats")),
            no_effect_match(F.col("_no_effects")),
            omitted,
            F.col("_heard"),
        ),
    ).drop("_near", "_repeats", "_no_effects", "_said", "_heard", *(["_task"] if tasks is not None else []))


def assess_steps(
    matched: DataFrame,
    tracked: DataFrame,
    threshold: float = 0.35,
    interval: int = 5,
    block: int = ordered.BLOCK,
    longs=ordered.LOOK_UP,
) -> DataFrame:
    """Add subgoal state, drift and reflection to matched steps."""
    counted = ordered.running(
        matched, "run_id", "step_index",
        {"matches_so_far": ("sum", F.col("match").isNotNull().cast("int"))},
        block=block, longs=longs,
    )
    joined = ordered.join_runs(counted, tracked, longs=longs, block=block).withColumn(
        "transition", tracking.own_transition()
    )
    step, match = F.col("step_index"), F.col("match")
    trigger = reflection.trigger_type(step, F.col("transition").isNotNull(), interval)

    def with_state(state: Column) -> Column:
        verdict = drift.from_state(state, step + 1, F.col("matches_so_far"), step, threshold)
        return tt.let(
            verdict,
            lambda d: F.struct(
                state.alias("state"),
                d.alias("drift"),
                reflection.reflect(
                    trigger, step, state["failed_subgoals_count"],
                    state["stalled_advanced_subgoals_count"], state["current_subgoal_id"],
                    d, match,
                ).alias("reflection"),
            ),
        )

    # One nested expression, and a row made of it: a filter on its result would be pushed
    # down and repeat it once per reference, but does not pass a generator.
    whole = tt.let(tracking.state_struct(step, tracking.step_stamp(counted)), with_state)
    parts = ["state", "drift", "reflection"]
    return (
        joined.withColumn("_a", F.explode(F.array(whole)))
        .withColumns({name: F.col(f"_a.{name}") for name in parts})
        .drop("_a", *tracking.TRACKED)
    )


def verdicts(assessed: DataFrame, block_on_critical: bool = False) -> DataFrame:
    """Add the reported columns of a step: flagged, category, warning and so on."""
    m, d, r = F.col("match"), F.col("drift"), F.col("reflection")
    hit, drifted, revise = m.isNotNull(), d["drift_detected"], r["revision_suggested"]
    advice = F.nullif(r["revision_reasoning"], F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    warning = F.concat_ws(
        " | ",
        F.when(
            hit,
            F.concat(
                F.lit("["), m["layer"], F.lit(":"),
                F.coalesce(F.nullif(m["rule_id"], F.lit("")), m["pattern_id"]),
                F.lit("] "), m["category"],
                F.format_string(" (confidence=%.2f): ", m["confidence"]), m["description"],
            ),
        ),
        F.when(
            drifted,
            F.concat(
                F.lit("[drift_monitor:"), F.array_join(d["triggered_signals"], ","),
                F.lit("] severity="), d["severity_level"], F.lit(": "),
                F.array_join(d["reasons"], "; "),
            ),
        ),
        F.when(
            revise,
            F.concat(
                F.lit("[reflector:"), r["trigger_type"],
                F.lit("] Plan revision suggested: "), r["revision_reasoning"],
            ),
        ),
    )
    confidence = (
        F.when(hit, m["confidence"])
        .when(drifted, d["severity_score"])
        .when(revise, r["confidence"])
        .otherwise(0.0)
    )
    flagged = hit | drifted | revise
    stop = (
        flagged
        & F.lit(block_on_critical)
        & (
            (d["severity_level"] == "critical")
            | F.coalesce(m["rule_id"] == "structural_action_repetition", F.lit(False))
            | (F.col("confidence") >= 0.85)
        )
    )
    return (
        assessed.withColumn("flagged", flagged)
        .withColumn("drift_detected", hit | drifted)
        .withColumn("warning", F.nullif(warning, F.lit("")))
        .withColumn(
            "category",
            F.when(hit, m["category"]).when(drifted, F.lit("drift")).when(
                revise, F.lit("planning_error")
            ),
        )
        .withColumn("confidence", confidence)
        .withColumn(
            "suggestions",
            F.when(
                flagged,
                F.array_compact(F.array(F.nullif(m["safe_alternative"], F.lit("")), advice)),
            ).otherwise(none),
        )
        .withColumn("continue_execution", ~stop)
    )


def check_steps(
    steps: DataFrame,
    plans: DataFrame,
    settings: Settings | None = None,
    near: DataFrame | None = None,
    boundaries: DataFrame | None = None,
    use_task: bool = True,
    tracked: DataFrame | None = None,
    **match_options,
) -> DataFrame:
    """The whole step check: match, subgoal state, drift, reflection, verdict.

    `tracked` is a result of `tracking.track` for the same steps and plans, if at hand.
    """
    settings = settings or Settings()
    block = match_options.get("block", ordered.BLOCK)
    longs = ordered.long_runs(steps, "run_id", "step_index", block)
    matched = match_steps(
        steps, tasks=plans if use_task else None, near=near, longs=longs, **match_options
    )
    if tracked is None:
        tracked = tracking.track(steps, plans, settings.max_subgoal_steps, boundaries)
    assessed = assess_steps(
        matched, tracked, settings.drift_threshold, settings.reflection_step_interval, block, longs
    )
    return verdicts(assessed, settings.block_on_critical).drop("_block")


def downstream_effects(
    steps: DataFrame, roots: DataFrame, words: list[str] | None = None,
    block: int = ordered.BLOCK,
) -> DataFrame:
    """First symptom word per field in the steps after a run's root step."""
    words = tx.SYMPTOM_WORDS if words is None else words
    marked = ordered.join_runs(
        steps, roots.select("run_id", F.col("root_cause_step_index").alias("_root")),
        how="inner", block=block,
    ).where(F.col("step_index") > F.col("_root"))
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.coalesce(name, F.lit("")).alias("value"))
            for name in ("tool_response", "reasoning")
        ]
    )
    return (
        marked.select("run_id", "step_index", F.explode(fields).alias("f"))
        .select(
            "run_id",
            "step_index",
            tt.first_contained(F.lower("f.value"), words).alias("keyword"),
            F.col("f.field").alias("field"),
            F.substring("f.value", 1, 100).alias("excerpt"),
        )
        .where(F.col("keyword").isNotNull())
    )


def system_error_step(step: Column, response: Column, limit: int = 30) -> Column:
    """`step_limit`, `candidate` (a scorer decides) or null, for a step from 1."""
    return F.when(step >= limit, "step_limit").when(
        tt.contains_any(F.lower(response), tx.SYSTEM_WORDS), "candidate"
    )


def module_checks_due(steps: DataFrame, env: str = "alfworld") -> DataFrame:
    """(run, step, module) rows that need judging.

    steps(run_id, step, memory, reflection, planning, action)
    """
    modules = F.array(
        *[
            F.struct(F.lit(m).alias("module"), F.coalesce(m, F.lit("")).alias("content"))
            for m in ("memory", "reflection", "planning", "action")
        ]
    )
    rows = steps.select("run_id", "step", F.explode(modules).alias("m")).select(
        "run_id", "step", "m.module", "m.content"
    )
    looks_back = F.col("module").isin("memory", "reflection")
    skip = looks_back & (
        (F.col("step") == 1) | (F.lit(env == "webshop") & (F.col("content") == ""))
    )
    return rows.where(~skip)


def step_summaries(findings: DataFrame) -> DataFrame:
    """One line per step from findings(run_id, step, module, error_type, error_detected).

    A step has at most one finding per module, so the list stays short.
    """
    order = list(tx.MODULE_TYPES)
    rank = F.array_position(F.array(*[F.lit(m) for m in ["system"] + order]), F.col("module"))
    entry = F.when(
        F.col("error_detected"),
        F.struct(rank.alias("r"), F.concat_ws(":", "module", "error_type").alias("t")),
    )
    per_module = findings.withColumn("_e", entry).groupBy("run_id", "step", "module").agg(
        F.max("_e").alias("_e")
    )
    listed = F.transform(F.array_sort(F.collect_list("_e")), lambda x: x["t"])
    return (
        per_module.groupBy("run_id", "step")
        .agg(listed.alias("errors"))
        .select(
            "run_id",
            "step",
            F.size("errors").alias("n_errors"),
            F.concat(
                F.lit("Step "), F.col("step").cast("string"), F.lit(": "),
                F.when(
                    F.size("errors") > 0,
                    F.concat(F.lit("Errors detected - "), F.array_join("errors", ", ")),
                ).otherwise(F.lit("No errors detected")),
            ).alias("step_summary"),
        )
    )
