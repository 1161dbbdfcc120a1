"""Live sessions: one row of judgment per event, as events arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import attrgetter
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stepscope import taxonomy as tx
from stepscope.config import Settings
from stepscope.functions import text as tt
from stepscope.operators import detectors, shaping
from stepscope.plans import checks, drift, parsing, reflection, tracking
from stepscope.streaming import fold

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = """
session_id string, kind string, seq long, ts timestamp, step_index int, action_name string,
args_key string, tool_response string, repeats int, no_effects int, failed_repeats int,
matches_so_far int, ended string, current_subgoal_id string, status string,
steps_in_current_subgoal int, completed_subgoals_count int,
stalled_advanced_subgoals_count int, failed_subgoals_count int, total_subgoals_count int,
active_subgoal_index int, is_fallback boolean, total_steps int,
reasoning string, contradicted int, omitted int
"""
_NAMES = [part.split()[0] for part in OUT.replace("\n", " ").split(",")]
_ROW = Row(*_NAMES)
_SEQ = attrgetter("seq")


def prepare(events: DataFrame, phrase: str = detectors.NO_EFFECT, rules=None,
            keys: list[str] = ("action_name", "args_key")) -> DataFrame:
    """Session events with all flags the fold needs; pure projection.

    Events may have a column `reasoning`.
    """
    plan = F.coalesce(
        F.nullif("plan", F.lit("")),
        F.when(tt.contains_any(F.col("prompt"), tx.PROMPT_PLAN_MARKERS), F.col("prompt")),
        F.lit(""),
    )
    reasoning = F.coalesce("reasoning", F.lit("")) if "reasoning" in events.columns else F.lit("")
    base = events.select(
        F.col("session_id").cast("string").alias("session_id"),
        "seq",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("hook_event_name").alias("event"),
        "prompt",
        F.coalesce("tool_name", F.lit("")).alias("action_name"),
        F.coalesce(tt.canonical_json(F.col("tool_input")), F.lit("")).alias("args_key"),
        F.coalesce("tool_response", F.lit("")).alias("tool_response"),
        reasoning.alias("reasoning"),
        F.when(F.col("hook_event_name") == "UserPromptSubmit", parsing.plan_items(plan)).alias("_p"),
    )
    ruled = tt.add_keyword_rule(base, "_said", detectors.STEP_TEXT, rules)
    ruled = tt.add_keyword_rule(ruled, "_heard", "tool_response", rules)
    flags = tracking.step_flags(ruled)
    items = F.coalesce(F.col("_p.items"), F.expr("cast(array() as array<string>)"))
    # A prompt gives the task's terms, a search the terms of the plan it stands for.
    search = F.lower("action_name").contains("search")
    planned = F.concat_ws(" ", "action_name", "args_key")
    named = F.when(F.col("event") == "UserPromptSubmit", F.col("prompt")).when(search, planned)
    return flags.select(
        search.alias("searches"),
        checks.acts(planned).alias("acts"),
        checks.opposed_flags(named).alias("opposed"),
        checks.required_flags(named).alias("required"),
        "reasoning",
        "session_id", "seq", "ts", "event", "action_name", "args_key", "tool_response",
        detectors.action_key(list(keys)).alias("action_key"),
        F.col("_said").isNotNull().alias("said_hit"),
        F.col("_heard").isNotNull().alias("heard_hit"),
        F.lower("tool_response").contains(phrase).alias("no_effect"),
        tt.response_failed(F.col("tool_response")).alias("response_failed"),
        F.coalesce("failure_term", F.lit("")).alias("failure_term"),
        F.coalesce("success_phrase", F.lit("")).alias("success_phrase"),
        "step_words",
        items.alias("descriptions"),
        F.transform(items, lambda d, i: F.format_string("subgoal_%03d", i + 1)).alias("subgoal_ids"),
        tracking.subgoal_words(items).alias("subgoal_words"),
        F.coalesce("_p.is_fallback", F.lit(True)).alias("is_fallback"),
        shaping.is_placeholder(F.col("prompt")).alias("is_placeholder"),
        F.coalesce(shaping.is_substantive(F.col("prompt")), F.lit(False)).alias("is_substantive"),
    )


# Flags of an event, one bit each in this order.
FLAGS = [
    "said_hit", "heard_hit", "no_effect", "response_failed", "failure_term", "success_phrase",
    "searches", "acts", "is_placeholder", "is_substantive",
]


def packed(ready: DataFrame) -> DataFrame:
    """Prepared events in one column beside key and time, as each value handed to Python costs.

    A plan travels with its prompt only, the terms of a task with prompts and searches.
    """
    bits = F.lit(0)
    for i, name in enumerate(FLAGS):
        here = F.col(name) != "" if name in ("failure_term", "success_phrase") else F.col(name)
        bits = bits + F.when(here, 1 << i).otherwise(0)
    terms = ["opposed", "required"]
    plan = ["subgoal_ids", "descriptions", "subgoal_words", "is_fallback"]
    prompts = F.col("event") == "UserPromptSubmit"
    body = F.struct(
        "seq", F.col("event").alias("kind"), "action_name", "args_key", "tool_response",
        "reasoning", "action_key", "step_words", bits.alias("flags"),
        F.when(prompts, F.struct(*plan)).alias("plan"),
        F.when(prompts | F.col("searches"), F.struct(*terms)).alias("terms"),
    )
    return ready.select("session_id", "ts", F.to_json(body).alias("body"))


class SessionGuard(StatefulProcessor):
    """Keyed by session. State: counters, three short buffers and the plan's words."""

    def __init__(self, cap: int, idle_seconds: float):
        self.cap = cap
        self.idle_ms = int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("session", "body string")

    def _load(self) -> dict:
        held = self.saved.get()
        return json.loads(held[0]) if held else fold.fresh()

    def _row(self, session: str, kind: str, state: dict, event: Any = None, **values) -> Row:
        out = fold.snapshot(state)
        out.update(
            session_id=session, kind=kind, matches_so_far=state["matches"],
            total_steps=state["n"],
        )
        if event is not None:
            out.update(
                seq=event.seq, ts=event.ts, action_name=event.action_name,
                args_key=event.args_key, tool_response=event.tool_response,
                reasoning=event.reasoning,
            )
        out.update(values)
        return _ROW(*map(out.get, _NAMES))

    def _close(self, session: str, state: dict) -> list[Row]:
        if state["closed"] or not state["n"]:
            return []
        state["closed"] = True
        return [self._row(session, "summary", state, step_index=state["n"] - 1)]

    def _wake(self, state: dict, at: int | None) -> None:
        """Have the timer at `at` only, or none; the state knows when it is set."""
        if "timer" not in state:  # of a checkpoint from before it did
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        held = state.get("timer")
        if held is not None and held != at:
            self.handle.deleteTimer(held)
        if at is not None and held != at:
            self.handle.registerTimer(at)
        state["timer"] = at

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        session = key[0]
        state = self._load()
        newest = None
        for event in sorted((fold.Event(*row[1:]) for row in rows), key=_SEQ):
            if event.seq <= state["seq"]:
                state["late"] += 1
                yield self._row(session, "late", state, event)
                continue
            state["seq"] = event.seq
            if event.ts is not None and (newest is None or event.ts > newest):
                newest = event.ts
            if event.kind == "UserPromptSubmit":
                if fold.take_plan(state, event):
                    yield self._row(session, "plan", state, event)
            elif event.kind == "PreToolUse":
                fails = fold.failed_repeats(state, event.action_key)
                kind = "block" if fails >= 3 else "allow"
                yield self._row(session, kind, state, event, failed_repeats=fails)
            elif event.kind == "PostToolUse":
                state["closed"] = False
                fails = fold.failed_repeats(state, event.action_key)
                facts = fold.take_step(state, event, self.cap)
                yield self._row(session, "step", state, event, failed_repeats=fails, **facts)
            elif event.kind in ("Stop", "SessionEnd"):
                yield from self._close(session, state)
        awake = newest is not None and not state["closed"]
        self._wake(state, int(newest.timestamp() * 1000) + self.idle_ms if awake else None)
        self.saved.update((json.dumps(state),))

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        state = self._load()
        yield from self._close(key[0], state)
        state["timer"] = None
        self.saved.update((json.dumps(state),))

    def close(self) -> None:
        pass


def stream_guard(
    events: DataFrame,
    settings: Settings | None = None,
    idle_seconds: float = 30.0,
    watermark: str = "10 minutes",
    **options,
) -> DataFrame:
    """Judged rows of a stream of session events.

    Kinds: `plan`, `allow`, `block`, `step`, `summary` and `late`, the last for rows
    whose number is behind the session. A session is summed up when it stops, or after
    `idle_seconds` of event time without an event. Rows older than the watermark are
    the engine's to drop; it counts them in the progress report.
    """
    settings = settings or Settings()
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ready = packed(prepare(events, **options)).withWatermark("ts", watermark)
    judged = ready.groupBy("session_id").transformWithState(
        statefulProcessor=SessionGuard(max(1, settings.max_subgoal_steps), idle_seconds),
        outputStructType=OUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    return judge(judged, settings, **{k: v for k, v in options.items() if k == "rules"})


def judge(rows: DataFrame, settings: Settings, rules=None) -> DataFrame:
    """Match, drift, reflection and verdict from the fold's counters; pure projection."""
    base = tt.add_keyword_rule(rows, "_said", detectors.STEP_TEXT, rules)
    base = tt.add_keyword_rule(base, "_heard", "tool_response", rules)
    def numbered(column: str, matches: list) -> Column:
        return F.coalesce(*[F.when(F.col(column) == i, m) for i, m in enumerate(matches)])

    match = F.coalesce(
        numbered("contradicted", checks.contradiction_matches()),
        F.col("_said"),
        detectors.repetition_match(F.col("repeats")),
        detectors.no_effect_match(F.col("no_effects")),
        numbered("omitted", checks.omission_matches()),
        F.col("_heard"),
    )
    step = F.col("kind") == "step"
    ratio = F.round(
        (F.col("completed_subgoals_count") + F.col("stalled_advanced_subgoals_count"))
        / F.greatest(F.col("total_subgoals_count"), F.lit(1)),
        3,
    )
    final = F.col("kind") == "summary"
    base = base.withColumn("match", F.when(step, match)).withColumn(
        "drift",
        drift.assess(
            F.col("stalled_advanced_subgoals_count"),
            F.col("failed_subgoals_count"),
            F.when(
                final,
                F.col("completed_subgoals_count")
                / F.greatest(F.col("total_subgoals_count"), F.lit(1)),
            ).otherwise(ratio),
            F.when(final, F.lit(0)).otherwise(F.col("steps_in_current_subgoal")),
            F.when(final, F.col("total_steps")).otherwise(F.col("step_index") + 1),
            F.col("matches_so_far"),
            F.when(final, F.lit("final")).otherwise(F.col("current_subgoal_id")),
            F.col("step_index"),
            settings.drift_threshold,
        ),
    )
    trigger = F.when(final, F.lit("run_end")).otherwise(
        reflection.trigger_type(
            F.col("step_index"), F.col("ended").isNotNull(), settings.reflection_step_interval
        )
    )
    base = base.withColumn(
        "reflection",
        reflection.reflect(
            trigger, F.col("step_index"), F.col("failed_subgoals_count"),
            F.col("stalled_advanced_subgoals_count"),
            F.when(final, F.lit("final")).otherwise(F.col("current_subgoal_id")),
            F.col("drift"), F.col("match"),
        ),
    )
    return detectors.verdicts(base, settings.block_on_critical).drop(
        "_said", "_heard", "reasoning", "contradicted", "omitted"
    )
