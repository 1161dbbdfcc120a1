"""Subgoal progress of each run.

A subgoal takes at least one step and at most `max_steps`, so all transitions of a
plan with k subgoals fall into its first k * max_steps steps. Only those steps are
folded, in one small array per run; every later step sees a finished plan. The fold
is exact and its size depends on the plan text alone, never on the run's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope.functions import text as tt
from stepscope.operators import ordered
from stepscope.plans import parsing

TERMINAL = ["completed", "stalled_advanced", "failed"]
_DONE = (
    "array<struct<no:int,step:int,status:string,reason:string,steps:int,"
    "next_no:int,base:int,at:double,host:boolean>>"
)


def step_flags(steps: DataFrame) -> DataFrame:
    """Stateless outcome flags of a step: failure term, success phrase, own words."""
    response = F.lower(F.coalesce("tool_response", F.lit("")))
    said = F.lower(
        F.concat_ws(
            " ",
            F.coalesce("reasoning", F.lit("")),
            F.coalesce("action_name", F.lit("")),
            F.coalesce("args_key", F.lit("")),
        )
    )
    return (
        steps.withColumn("failure_term", tt.failure_term(response))
        .withColumn("success_phrase", tt.success_phrase(response))
        .withColumn("step_words", said)
    )


def subgoal_words(descriptions: Column) -> Column:
    """Words longer than three characters of each description."""
    return F.transform(
        descriptions,
        lambda d: F.filter(
            F.regexp_extract_all(F.lower(d), F.lit("[a-z0-9]+"), F.lit(0)),
            lambda w: F.length(w) > 3,
        ),
    )


def aligned(words: Column, said: Column) -> Column:
    """Do two or more of the words (repeats count) occur in the step's own text?"""
    return F.size(F.filter(words, lambda w: F.contains(said, w))) >= 2


def step_outcomes(steps: DataFrame, plans: DataFrame) -> DataFrame:
    """Flags per step and the subgoals its words align with, one row per step."""
    parsed = parsing.with_subgoals(plans).select(
        "run_id", subgoal_words(F.col("descriptions")).alias("_words")
    )
    joined = ordered.join_runs(step_flags(steps), parsed)
    hits = F.transform(
        F.coalesce("_words", F.array().cast("array<array<string>>")),
        lambda w, i: F.when(aligned(w, F.col("step_words")), i),
    )
    return joined.withColumn("aligned_with", F.array_compact(hits)).drop("_words")


def track(
    steps: DataFrame,
    plans: DataFrame,
    max_steps: int = 10,
    boundaries: DataFrame | None = None,
) -> DataFrame:
    """One row per plan: its subgoals and the transitions they went through.

    `boundaries(run_id, subgoal_id, status, step_index)` are status updates from
    outside; they take effect before the step of that index. An update counts once
    per subgoal; an unknown id means the active subgoal.
    """
    cap = max(1, int(max_steps))
    subgoals = parsing.with_subgoals(plans).select(
        "run_id", "subgoal_ids", "descriptions", "is_fallback", "total_subgoals",
        subgoal_words(F.col("descriptions")).alias("_words"),
    )
    longest = subgoals.agg(F.coalesce(F.max("total_subgoals"), F.lit(0)).alias("n"))
    early = steps.where(F.col("step_index") < longest.scalar() * cap)
    flags = step_flags(early)
    stamp = step_stamp(steps)
    feed = flags.select(
        "run_id",
        F.struct(
            F.col("step_index").cast("int").alias("pos"),
            F.lit(1).alias("kind"),
            F.col("failure_term").alias("failed"),
            F.col("success_phrase").alias("success"),
            F.col("step_words").alias("said"),
            F.lit(None).cast("string").alias("target"),
            F.lit(None).cast("string").alias("status"),
            stamp.alias("at"),
        ).alias("e"),
    )
    if boundaries is not None:
        once = ordered.first_by(
            boundaries.where(F.col("status").isin(*TERMINAL)).select(
                "run_id", "subgoal_id", "status", "step_index"
            ),
            ["run_id", "subgoal_id"],
            [F.col("step_index")],
        )
        host = once.select(
            "run_id",
            F.struct(
                F.col("step_index").cast("int").alias("pos"),
                F.lit(0).alias("kind"),
                F.lit(None).cast("string").alias("failed"),
                F.lit(None).cast("string").alias("success"),
                F.lit(None).cast("string").alias("said"),
                F.col("subgoal_id").alias("target"),
                F.col("status"),
                F.lit(None).cast("double").alias("at"),
            ).alias("e"),
        )
        feed = feed.unionByName(host)
    # Cut each run at its own bound before anything is collected.
    sizes = subgoals.select("run_id", F.col("total_subgoals").alias("_k"))
    bounded = feed.join(sizes, "run_id").where(
        (F.col("e.kind") == 0) | (F.col("e.pos") < F.col("_k") * cap)
    )
    events = bounded.groupBy("run_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    joined = subgoals.join(events, "run_id", "left")
    total, ids, words = F.col("total_subgoals"), F.col("subgoal_ids"), F.col("_words")

    def following(done: Column, k: Column) -> Column:
        if boundaries is None:
            return k + 1
        free = F.filter(
            F.sequence(k + 1, F.greatest(total, k + 1)),
            lambda j: ~F.exists(done, lambda d: d["no"] == j),
        )
        return F.array_min(free)

    def state(k, cnt, base, done) -> Column:
        return F.struct(
            k.cast("int").alias("k"), cnt.cast("int").alias("cnt"),
            base.cast("int").alias("base"), done.alias("done"),
        )

    def entry(no, e, status, reason, steps_in, next_no, base, host) -> Column:
        return F.array(
            F.struct(
                no.cast("int").alias("no"), e["pos"].alias("step"), status.alias("status"),
                reason.alias("reason"), steps_in.cast("int").alias("steps"),
                next_no.cast("int").alias("next_no"), base.cast("int").alias("base"),
                e["at"].alias("at"), F.lit(host).alias("host"),
            )
        ).cast(_DONE)

    def on_step(acc: Column, e: Column) -> Column:
        def judge(nxt: Column) -> Column:
            next_words = F.get(words, nxt)
            lined_up = F.coalesce(
                (nxt < total) & aligned(next_words, e["said"]), F.lit(False)
            )
            count = acc["cnt"] + 1
            verdict = (
                F.when(
                    e["failed"].isNotNull(),
                    F.struct(
                        F.lit("failed").alias("status"),
                        F.concat(
                            F.lit("Step tool response contained failure keyword '"),
                            e["failed"], F.lit("'"),
                        ).alias("reason"),
                    ),
                )
                .when(
                    lined_up,
                    F.struct(
                        F.lit("completed").alias("status"),
                        F.concat(
                            F.lit("Step actions aligned with next subgoal '"),
                            F.get(ids, nxt), F.lit("'"),
                        ).alias("reason"),
                    ),
                )
                .when(
                    e["success"].isNotNull(),
                    F.struct(
                        F.lit("completed").alias("status"),
                        F.concat(
                            F.lit("Observation confirmed success keyword '"),
                            e["success"], F.lit("'"),
                        ).alias("reason"),
                    ),
                )
                .when(
                    count >= cap,
                    F.struct(
                        F.lit("stalled_advanced").alias("status"),
                        F.format_string(
                            f"Subgoal step threshold reached (%d steps >= max {cap} "
                            "without completion — force advanced)",
                            count,
                        ).alias("reason"),
                    ),
                )
            )
            return tt.let(
                verdict,
                lambda v: F.when(
                    v.isNull(), state(acc["k"], count, acc["base"], acc["done"])
                ).otherwise(
                    state(
                        nxt, F.lit(0), e["pos"],
                        F.concat(
                            acc["done"],
                            entry(acc["k"], e, v["status"], v["reason"], count, nxt, e["pos"], False),
                        ),
                    )
                ),
            )

        return tt.let(following(acc["done"], acc["k"]), judge)

    def on_host(acc: Column, e: Column) -> Column:
        named = F.array_position(ids, e["target"])
        target = F.when(named > 0, (named - 1).cast("int")).otherwise(acc["k"])

        def apply(no: Column) -> Column:
            known = F.exists(acc["done"], lambda d: d["no"] == no)
            active = no == acc["k"]
            nxt = F.when(active, following(acc["done"], acc["k"])).otherwise(acc["k"])
            base = F.when(active, e["pos"] - 1).otherwise(acc["base"])
            return F.when((no >= total) | known, acc).otherwise(
                state(
                    nxt,
                    F.when(active, F.lit(0)).otherwise(acc["cnt"]),
                    base,
                    F.concat(
                        acc["done"],
                        entry(
                            no, e, e["status"], F.lit("host_boundary_event"),
                            F.when(active, acc["cnt"]).otherwise(F.lit(0)), nxt, base, True,
                        ),
                    ),
                )
            )

        return tt.let(target, apply)

    def merge(acc: Column, e: Column) -> Column:
        moved = on_step(acc, e)
        if boundaries is not None:
            moved = F.when(e["kind"] == 0, on_host(acc, e)).otherwise(moved)
        return F.when(acc["k"] >= total, acc).otherwise(moved)

    start = state(F.lit(0), F.lit(0), F.lit(-1), F.expr(f"cast(array() as {_DONE})"))
    folded = joined.withColumn(
        "_end",
        F.aggregate(
            F.coalesce("events", F.expr("cast(array() as array<struct<pos:int,kind:int,"
                       "failed:string,success:string,said:string,target:string,"
                       "status:string,at:double>>)")),
            start,
            merge,
        ),
    )
    return folded.select(
        "run_id", "subgoal_ids", "descriptions", "is_fallback", "total_subgoals",
        F.col("_end.done").alias("transitions"),
        F.col("_end.k").alias("active_no"),
        F.array_min(F.transform("events", lambda e: e["at"])).alias("first_at"),
    )


def transitions(tracked: DataFrame) -> DataFrame:
    """One row per subgoal that ended."""
    return tracked.select(
        "run_id", "subgoal_ids", F.explode("transitions").alias("t")
    ).select(
        "run_id",
        F.col("t.step").alias("step_index"),
        F.get("subgoal_ids", F.col("t.no")).alias("completed_subgoal_id"),
        F.col("t.no").alias("subgoal_no"),
        F.col("t.status").alias("completed_status"),
        F.col("t.reason").alias("trigger_reason"),
        F.col("t.steps").alias("steps_used"),
        F.get("subgoal_ids", F.col("t.next_no")).alias("next_subgoal_id"),
        F.col("t.status").isin("completed", "stalled_advanced").alias("checkpoint_passed"),
        F.col("t.host").alias("from_host"),
    )


def state_struct(pos: Column, at: Column) -> Column:
    """State after the step at `pos`, from the columns of `track`."""
    total = F.coalesce("total_subgoals", F.lit(0))
    ids, texts = F.col("subgoal_ids"), F.col("descriptions")
    empty = F.expr(f"cast(array() as {_DONE})")
    so_far = F.filter(F.coalesce("transitions", empty), lambda t: t["step"] <= pos)

    def build(done: Column) -> Column:
        def count(status: str) -> Column:
            return F.size(F.filter(done, lambda t: t["status"] == status))

        last = F.try_element_at(done, F.lit(-1))
        active = F.coalesce(last["next_no"], F.lit(0))
        base = F.coalesce(last["base"], F.lit(-1))
        final = F.try_element_at(F.filter(done, lambda t: t["no"] == total - 1), F.lit(-1))
        over = active >= total
        shown = F.least(active, total - 1)
        began = F.coalesce(
            F.try_element_at(F.filter(done, lambda t: t["at"].isNotNull()), F.lit(-1))["at"],
            F.col("first_at"),
        )
        completed, stalled = count("completed"), count("stalled_advanced")
        planned = total > 0
        return F.struct(
            F.get(ids, shown).alias("current_subgoal_id"),
            F.get(texts, shown).alias("current_subgoal_description"),
            F.when(~planned, F.lit("not_started"))
            .when(over, final["status"])
            .otherwise(F.lit("in_progress"))
            .alias("status"),
            F.when(~planned, F.lit(0))
            .when(over, final["steps"])
            .otherwise(pos - base)
            .cast("int")
            .alias("steps_in_current_subgoal"),
            F.when(planned & ~over, F.round(at - began, 2))
            .otherwise(F.lit(0.0))
            .alias("time_in_current_subgoal_seconds"),
            completed.alias("completed_subgoals_count"),
            stalled.alias("stalled_advanced_subgoals_count"),
            count("failed").alias("failed_subgoals_count"),
            F.lit(0).alias("abandoned_subgoals_count"),
            total.alias("total_subgoals_count"),
            F.round((completed + stalled) / F.greatest(total, F.lit(1)), 3).alias(
                "subgoal_progress_ratio"
            ),
            F.greatest(shown, F.lit(0)).alias("active_subgoal_index"),
            F.coalesce("is_fallback", F.lit(True)).alias("is_fallback"),
        )

    return tt.let(so_far, build)


TRACKED = [
    "subgoal_ids", "descriptions", "is_fallback", "total_subgoals", "transitions",
    "active_no", "first_at",
]


def step_stamp(steps: DataFrame) -> Column:
    stamp = F.col("timestamp") if "timestamp" in steps.columns else F.lit(None)
    return stamp.cast("double")


def own_transition() -> Column:
    """The transition that the step itself brought about, or null."""
    here = F.filter(
        F.col("transitions"), lambda t: (t["step"] == F.col("step_index")) & ~t["host"]
    )
    return F.try_element_at(here, F.lit(1))


def subgoal_state(
    steps: DataFrame,
    tracked: DataFrame,
    longs=ordered.LOOK_UP,
    block: int = ordered.BLOCK,
) -> DataFrame:
    """Add struct `state` (after the step) and `transition` (at the step, or null)."""
    joined = ordered.join_runs(steps, tracked, longs=longs, block=block)
    return (
        joined.withColumn("state", state_struct(F.col("step_index"), step_stamp(steps)))
        .withColumn("transition", own_transition())
        .drop(*TRACKED)
    )


def finalize(tracked: DataFrame) -> DataFrame:
    """Totals per run at its end; subgoals that never ended are abandoned."""

    def count(status: str) -> Column:
        return F.size(F.filter("transitions", lambda t: t["status"] == status))

    return tracked.select(
        "run_id",
        "total_subgoals",
        count("completed").alias("completed_count"),
        count("stalled_advanced").alias("stalled_advanced_count"),
        count("failed").alias("failed_count"),
        (F.col("total_subgoals") - F.size("transitions")).alias("abandoned_count"),
        "is_fallback",
    )


def final_subgoals(tracked: DataFrame) -> DataFrame:
    """One row per declared subgoal with its last status."""
    listed = tracked.select(
        "run_id", "transitions",
        F.posexplode(F.arrays_zip("subgoal_ids", "descriptions")).alias("subgoal_no", "s"),
    )
    ended = F.try_element_at(
        F.filter("transitions", lambda t: t["no"] == F.col("subgoal_no")), F.lit(1)
    )
    return listed.withColumn("_t", ended).select(
        "run_id",
        "subgoal_no",
        F.col("s.subgoal_ids").alias("subgoal_id"),
        F.col("s.descriptions").alias("description"),
        F.coalesce("_t.status", F.lit("abandoned")).alias("status"),
        F.coalesce("_t.reason", F.lit("Run ended before subgoal completion")).alias(
            "completion_trigger"
        ),
        F.col("_t.step").alias("ended_at_step"),
    )
