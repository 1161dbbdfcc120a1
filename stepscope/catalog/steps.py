"""Queries on step detectors, run state, root causes and live windows."""

from __future__ import annotations

import json

import uuid

from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.catalog import inputs as src
from stepscope.catalog.registry import SQL, query, with_
from stepscope.catalog.reshape import contains_sql, quoted
from stepscope.config import Settings
from stepscope.functions import text as tt
from stepscope.operators import detectors, judging
from stepscope.plans import drift, evaluate, reflection, rootcause, summary, tracking
from stepscope.session import checkpoint_folder, keep
from stepscope.streaming import guard, sinks, windows

KEYS = ["action_name"]
SETTINGS = Settings(max_subgoal_steps=src.STEP_CAP, block_on_critical=True)

_LAG5 = " + ".join(f"coalesce(CAST(lag(action_name, {i}) OVER w = action_name AS INTEGER), 0)" for i in range(1, 6))
_LAG3 = " + ".join(
    f"coalesce(CAST(contains(lower(lag(tool_response, {i}) OVER w), 'error') AS INTEGER), 0)" for i in range(1, 4)
)
_LAG4 = " + ".join(
    f"coalesce(CAST(lag(action_name, {i}) OVER w = action_name AND {contains_sql(f'lower(lag(tool_response, {i}) OVER w)', tx.RESPONSE_ERRORS)} AS INTEGER), 0)"
    for i in range(1, 5)
)
LOOK_SQL = f"""looked AS (
  SELECT *, {_LAG5} AS repeats, CASE WHEN contains(lower(tool_response), 'error') THEN {_LAG3} END AS no_effects,
         {_LAG4} AS failed_repeats
  FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step_index))"""
MATCH_SQL = """matched AS (
  SELECT *, CASE WHEN repeats >= 2 THEN 'memory_error' WHEN no_effects >= 2 THEN 'tool_use_error' END AS m_cat,
         CASE WHEN repeats >= 2 THEN least(0.90, round(0.50 + repeats * 0.10, 10))
              WHEN no_effects >= 2 THEN least(0.85, round(0.50 + no_effects * 0.10, 10)) END AS m_conf,
         CASE WHEN repeats >= 2 THEN 'structural_action_repetition'
              WHEN no_effects >= 2 THEN 'structural_nothing_happens_loop' END AS m_rule,
         CASE WHEN repeats >= 2 THEN 'Action ''' || action_name || ''' repeated ' || repeats || ' times in last 5 steps'
              WHEN no_effects >= 2 THEN '''Nothing happens'' response ' || (no_effects + 1) || ' times in last 4 steps' END AS m_text
  FROM looked),
counted AS (SELECT *, sum(CASE WHEN m_cat IS NOT NULL THEN 1 ELSE 0 END) OVER
   (PARTITION BY run_id ORDER BY step_index ROWS UNBOUNDED PRECEDING) AS matches_so_far FROM matched)"""
_CYCLE = "[" + quoted(src.PLAN_CYCLE[i % 6] for i in range(src.PLAN_ITEMS)) + "]"
_N = src.PLAN_ITEMS
_OUTCOME = f"""CASE WHEN f.k >= {_N} THEN NULL
  WHEN s.tool_response LIKE 'Error%' THEN 'failed'
  WHEN f.k + 1 < {_N} AND ({_CYCLE})[f.k + 2] = s.action_name THEN 'completed'
  WHEN s.tool_response = 'success' THEN 'completed'
  WHEN f.cnt + 1 >= {src.STEP_CAP} THEN 'stalled_advanced' END"""
_REASON = f"""CASE WHEN f.k >= {_N} THEN NULL
  WHEN s.tool_response LIKE 'Error%' THEN 'Step tool response contained failure keyword ''error'''
  WHEN f.k + 1 < {_N} AND ({_CYCLE})[f.k + 2] = s.action_name
    THEN format('Step actions aligned with next subgoal ''subgoal_{{:03d}}''', f.k + 2)
  WHEN s.tool_response = 'success' THEN 'Observation confirmed success keyword ''success'''
  WHEN f.cnt + 1 >= {src.STEP_CAP} THEN 'Subgoal step threshold reached (' || (f.cnt + 1) ||
    ' steps >= max {src.STEP_CAP} without completion — force advanced)' END"""
FOLD_SQL = f"""folded AS (
  SELECT run_id, -1 AS n, 0 AS k, 0 AS cnt, 0 AS last_cnt, CAST(NULL AS VARCHAR) AS ended, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT run_id FROM steps)
  UNION ALL
  SELECT f.run_id, f.n + 1, CASE WHEN {_OUTCOME} IS NULL THEN f.k ELSE f.k + 1 END,
         CASE WHEN f.k >= {_N} THEN f.cnt WHEN {_OUTCOME} IS NULL THEN f.cnt + 1 ELSE 0 END,
         CASE WHEN {_OUTCOME} IS NULL THEN f.last_cnt ELSE f.cnt + 1 END, {_OUTCOME}, {_REASON}
  FROM folded f JOIN steps s ON s.run_id = f.run_id AND s.step_index = f.n + 1)"""
STATE_SQL = f"""states AS (
  SELECT run_id, n AS step_index, k, ended, reason, last_cnt,
         CASE WHEN k >= {_N} THEN last_cnt ELSE cnt END AS in_subgoal,
         count(*) FILTER (ended = 'completed') OVER w AS completed,
         count(*) FILTER (ended = 'stalled_advanced') OVER w AS stalled,
         count(*) FILTER (ended = 'failed') OVER w AS failed,
         arg_max(ended, n) FILTER (ended IS NOT NULL) OVER w AS last_ended,
         least(k, {_N - 1}) AS active
  FROM folded WHERE n >= 0 WINDOW w AS (PARTITION BY run_id ORDER BY n ROWS UNBOUNDED PRECEDING))"""


def drift_sql(name: str, source: str, stalled: str, failed: str, ratio: str, within: str,
              total: str, matches: str, subgoal: str) -> str:
    """Signals, score, level and reasons over a source, in SQL."""
    return f"""{name}_raw AS (
  SELECT *, {stalled} >= 2 AS s1, ({total} >= 8 AND {ratio} < 0.20) OR {within} >= 8 AS s2,
         {failed} >= 2 OR {failed} + {stalled} >= 3 AS s3, {matches} >= 2 AS s4 FROM {source}),
{name}_scored AS (
  SELECT *, least(1.0, round((CASE WHEN s1 THEN 0.45 ELSE 0 END) + (CASE WHEN s2 THEN 0.35 ELSE 0 END)
         + (CASE WHEN s3 THEN 0.40 ELSE 0 END) + (CASE WHEN s4 THEN 0.30 ELSE 0 END), 3))::DOUBLE AS score,
         array_to_string(list_filter([CASE WHEN s1 THEN 'REPEATED_STALLED_SUBGOALS' END,
           CASE WHEN s2 THEN 'SLOW_PROGRESS_RATIO' END, CASE WHEN s3 THEN 'ACCUMULATED_SUBGOAL_FAILURES' END,
           CASE WHEN s4 THEN 'PATTERN_REPETITION_DRIFT' END], lambda x: x IS NOT NULL), ',') AS signals,
         array_to_string(list_filter([
           CASE WHEN s1 THEN 'Repeated stalled subgoals detected: ' || {stalled} || ' subgoals force-advanced after step limit' END,
           CASE WHEN s2 THEN 'Slow progress ratio (' || format('{{:.2f}}', ({ratio})::DOUBLE) || ' after ' || {total} || ' total steps, '
             || {within} || ' steps in active subgoal ''' || {subgoal} || ''')' END,
           CASE WHEN s3 THEN 'Accumulated subgoal failures: ' || {failed} || ' failed, ' || {stalled} || ' stalled-advanced' END,
           CASE WHEN s4 THEN 'Pattern repetition drift: ' || {matches} || ' step flags raised' END],
           lambda x: x IS NOT NULL), '; ') AS reasons
  FROM {name}_raw),
{name} AS (SELECT *, score >= 0.35 AS drifted,
   CASE WHEN score < 0.35 THEN 'none' WHEN score < 0.60 THEN 'medium' WHEN score < 0.85 THEN 'high' ELSE 'critical' END AS level
   FROM {name}_scored)"""


_RATIO = f"round((completed + stalled) / {_N}, 3)"
JOINED_SQL = """both_sides AS (SELECT c.*, s.k, s.ended, s.in_subgoal, s.completed, s.stalled, s.failed,
  s.active, format('subgoal_{:03d}', s.active + 1) AS subgoal
  FROM counted c JOIN states s ON s.run_id = c.run_id AND s.step_index = c.step_index)"""
DRIFT_SQL = drift_sql(
    "drifts", "both_sides", "stalled", "failed", _RATIO, "in_subgoal", "(step_index + 1)",
    "matches_so_far", "subgoal",
)


def reflect_sql(name: str, source: str, trigger: str, step: str, subgoal: str, match: bool) -> str:
    caught = (
        "CASE WHEN m_conf >= 0.40 AND m_cat IN ('planning_error', 'reflection_error') THEN 'StepCheck' END"
        if match else "NULL"
    )
    return f"""{name}_why AS (
  SELECT *, {trigger} AS trig, list_filter([
    CASE WHEN failed >= 2 THEN failed || ' subgoals failed explicitly (active: ''' || {subgoal} || ''')' END,
    CASE WHEN stalled >= 2 THEN stalled || ' subgoal(s) force-advanced due to step limit stalls' END,
    CASE WHEN level IN ('high', 'critical') OR score >= 0.60 OR (drifted AND stalled + failed >= 1)
         THEN 'Drift monitor severity high (' || format('{{:.2f}}', score) || ', signals: ' || signals || ')' END,
    {caught}], lambda x: x IS NOT NULL) AS why FROM {source}),
{name} AS (
  SELECT *, trig IS NOT NULL AND len(why) > 0 AS revise,
    CASE WHEN trig IS NULL THEN '' ELSE 'Plan re-evaluation at step ' || {step} || ' (' || trig || '): ' ||
      CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') || '. Original plan strategy is no longer optimal — revision recommended.'
           ELSE 'Original plan remains valid and achievable.' END END AS reasoning_text,
    CASE WHEN trig IS NULL THEN 1.0 WHEN len(why) > 0 THEN round(least(0.95, 0.5 + len(why) * 0.2), 2) ELSE 0.85 END::DOUBLE AS r_conf
  FROM {name}_why)"""


_TRIGGER = """CASE WHEN ended IS NOT NULL THEN 'subgoal_boundary'
  WHEN step_index > 0 AND step_index % 5 = 0 THEN 'step_interval' END"""
REFLECT_SQL = reflect_sql("reflected", "drifts", _TRIGGER, "step_index", "subgoal", True)
VERDICT_SQL = """verdicts AS (SELECT *,
  m_cat IS NOT NULL OR drifted OR revise AS flagged,
  CASE WHEN m_cat IS NOT NULL THEN m_cat WHEN drifted THEN 'drift' WHEN revise THEN 'planning_error' END AS category,
  CASE WHEN m_cat IS NOT NULL THEN m_conf WHEN drifted THEN score WHEN revise THEN r_conf ELSE 0.0 END::DOUBLE AS confidence,
  nullif(array_to_string(list_filter([
    CASE WHEN m_cat IS NOT NULL THEN '[keyword:' || m_rule || '] ' || m_cat || ' (confidence=' || format('{:.2f}', m_conf::DOUBLE) || '): ' || m_text END,
    CASE WHEN drifted THEN '[drift_monitor:' || signals || '] severity=' || level || ': ' || reasons END,
    CASE WHEN revise THEN '[reflector:' || trig || '] Plan revision suggested: ' || reasoning_text END],
    lambda x: x IS NOT NULL), ' | '), '') AS warning
  FROM reflected)"""

_CHAIN = [src.STEPS_SQL, LOOK_SQL, MATCH_SQL]
_FULL = [*_CHAIN, FOLD_SQL, STATE_SQL, JOINED_SQL, DRIFT_SQL, REFLECT_SQL, VERDICT_SQL]


def rec(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _matched(spark, sf):
    return detectors.match_steps(src.steps(spark, sf), keys=KEYS, phrase="error").drop("_block")


def _checked(spark, sf):
    steps = src.stored_steps(spark, sf)
    return detectors.check_steps(
        steps, src.plans(spark, sf), SETTINGS, keys=KEYS, phrase="error", use_task=False
    )


def _tracked(spark, sf):
    return tracking.track(src.stored_steps(spark, sf), src.plans(spark, sf), src.STEP_CAP)


# ---- detectors ----

@query(
    "e1_action_repetition",
    with_(*_CHAIN) + """SELECT run_id, step_index, repeats, least(0.90, round(0.50 + repeats * 0.10, 10)) AS confidence
    FROM matched WHERE repeats >= 2""",
)
def e1(spark, sf):
    found = detectors.action_repetition(src.steps(spark, sf), keys=KEYS)
    return found.where("match IS NOT NULL").select("run_id", "step_index", "repeats", "match.confidence")


@query(
    "e2_no_effect_loop",
    with_(*_CHAIN) + """SELECT run_id, step_index, no_effects, least(0.85, round(0.50 + no_effects * 0.10, 10)) AS confidence
    FROM matched WHERE no_effects >= 2""",
)
def e2(spark, sf):
    found = detectors.no_effect_loop(src.steps(spark, sf), phrase="error")
    return found.where("match IS NOT NULL").select("run_id", "step_index", "no_effects", "match.confidence")


@query(
    "e6_match_steps",
    with_(*_CHAIN) + """SELECT run_id, step_index, m_cat AS category, m_conf::DOUBLE AS confidence, m_rule AS rule_id,
       m_text AS description FROM matched WHERE m_cat IS NOT NULL""",
)
def e6(spark, sf):
    return _matched(spark, sf).where("match IS NOT NULL").select(
        "run_id", "step_index", "match.category", "match.confidence", "match.rule_id", "match.description"
    )


@query(
    "e7_check_steps",
    rec(*_FULL) + """SELECT run_id, step_index, flagged, category, confidence, warning FROM verdicts""",
)
def e7(spark, sf):
    return _checked(spark, sf).select(
        "run_id", "step_index", "flagged", "category", "confidence", "warning"
    )


@query(
    "e8_continue_decision",
    rec(*_FULL) + """SELECT run_id, step_index, NOT (flagged AND (level = 'critical'
       OR coalesce(m_rule = 'structural_action_repetition', FALSE) OR confidence >= 0.85)) AS continue_execution FROM verdicts""",
)
def e8(spark, sf):
    return _checked(spark, sf).select("run_id", "step_index", "continue_execution")


@query(
    "e9_failing_loop_block",
    with_(src.STEPS_SQL, LOOK_SQL) + "SELECT run_id, step_index, failed_repeats, failed_repeats >= 3 AS blocked FROM looked",
)
def e9(spark, sf):
    return detectors.failing_loop_block(src.steps(spark, sf), keys=KEYS).select(
        "run_id", "step_index", "failed_repeats", "blocked"
    )


@query(
    "e11_failure_term",
    with_(src.STEPS_SQL) + """SELECT run_id, step_index, nullif(regexp_extract(tool_response, '(?i)\\b(?:error|errors|failed|failure)\\b'), '') AS failure_term FROM steps""",
)
def e11(spark, sf):
    return src.steps(spark, sf).select(
        "run_id", "step_index", tt.failure_term(F.col("tool_response")).alias("failure_term")
    )


@query(
    "e12_success_phrase",
    with_(src.STEPS_SQL) + """SELECT run_id, step_index, CASE WHEN contains(lower(tool_response), 'success') THEN 'success' END AS success_phrase FROM steps""",
)
def e12(spark, sf):
    return src.steps(spark, sf).select(
        "run_id", "step_index", tt.success_phrase(F.col("tool_response")).alias("success_phrase")
    )


_ROOTS_SQL = "roots AS (SELECT run_id, total_steps_taken // 2 AS root FROM runs)"


@query(
    "e13_downstream_effects",
    with_(src.STEPS_SQL, src.RUNS_SQL, _ROOTS_SQL) + """
    SELECT s.run_id, s.step_index, 'error' AS keyword, 'tool_response' AS field, substring(s.tool_response, 1, 100) AS excerpt
    FROM steps s JOIN roots r ON r.run_id = s.run_id AND s.step_index > r.root
    WHERE contains(lower(s.tool_response), 'error')""",
)
def e13(spark, sf):
    roots = src.runs(spark, sf).select(
        "run_id", F.floor(F.col("total_steps_taken") / 2).cast("int").alias("root_cause_step_index")
    )
    return detectors.downstream_effects(src.stored_steps(spark, sf), roots)


@query(
    "e14_system_error_step",
    with_(src.STEPS_SQL) + f"""SELECT run_id, step_index + 1 AS step, CASE WHEN step_index + 1 >= 30 THEN 'step_limit'
       WHEN {contains_sql('lower(tool_response)', tx.SYSTEM_WORDS)} THEN 'candidate' END AS system_error FROM steps""",
)
def e14(spark, sf):
    step = F.col("step_index") + 1
    return src.steps(spark, sf).select(
        "run_id", step.alias("step"),
        detectors.system_error_step(step, F.col("tool_response")).alias("system_error"),
    )


@query(
    "e15_module_checks_due",
    with_(src.STEPS_SQL) + """, modules AS (SELECT * FROM (VALUES ('memory'), ('reflection'), ('planning'), ('action')) AS t(module))
    SELECT s.run_id, s.step_index + 1 AS step, m.module,
           CASE m.module WHEN 'memory' THEN CASE WHEN s.action_name = 'view' THEN s.args_key ELSE '' END
                WHEN 'reflection' THEN CASE WHEN s.action_name = 'click' THEN s.args_key ELSE '' END
                WHEN 'planning' THEN '' ELSE s.action_name END AS content
    FROM steps s CROSS JOIN modules m
    WHERE NOT (m.module IN ('memory', 'reflection') AND (s.step_index = 0
          OR (m.module = 'memory' AND s.action_name <> 'view') OR (m.module = 'reflection' AND s.action_name <> 'click')))""",
)
def e15(spark, sf):
    steps = src.steps(spark, sf).select(
        "run_id",
        (F.col("step_index") + 1).alias("step"),
        F.when(F.col("action_name") == "view", F.col("args_key")).otherwise("").alias("memory"),
        F.when(F.col("action_name") == "click", F.col("args_key")).otherwise("").alias("reflection"),
        F.lit("").alias("planning"),
        F.col("action_name").alias("action"),
    )
    return detectors.module_checks_due(steps, env="webshop")


# ---- run state ----

@query(
    "f2_step_outcomes",
    with_(src.STEPS_SQL) + f"""SELECT run_id, step_index,
       nullif(regexp_extract(lower(tool_response), 'error'), '') AS failure_term,
       CASE WHEN tool_response = 'success' THEN 'success' END AS success_phrase,
       array_to_string([i - 1 for i in range(1, {_N + 1}) if ({_CYCLE})[i] = action_name], ',') AS aligned_with
    FROM steps""",
)
def f2(spark, sf):
    found = tracking.step_outcomes(src.stored_steps(spark, sf), src.plans(spark, sf))
    return found.select(
        "run_id", "step_index", "failure_term", "success_phrase",
        F.concat_ws(",", F.transform("aligned_with", lambda i: i.cast("string"))).alias("aligned_with"),
    )


@query(
    "f3_track_subgoals",
    rec(src.STEPS_SQL, FOLD_SQL) + f"""SELECT run_id, n AS step_index, format('subgoal_{{:03d}}', k) AS completed_subgoal_id,
       ended AS completed_status, reason AS trigger_reason,
       CASE WHEN k < {_N} THEN format('subgoal_{{:03d}}', k + 1) END AS next_subgoal_id FROM folded WHERE ended IS NOT NULL""",
)
def f3(spark, sf):
    return tracking.transitions(_tracked(spark, sf)).select(
        "run_id", "step_index", "completed_subgoal_id", "completed_status", "trigger_reason", "next_subgoal_id"
    )


def _host_events(spark, sf):
    """Sign-ups as outside news: the third subgoal is done, or one that is not in the plan."""
    steps = src.stored_steps(spark, sf)
    return steps, steps.where(F.col("action_name") == "signup").select(
        "run_id",
        F.when(F.col("step_index") > 12, "elsewhere").otherwise("subgoal_003").alias("subgoal_id"),
        F.lit("completed").alias("status"),
        F.col("step_index"),
    )


@query("f4_boundary_events")
def f4(spark, sf):
    steps, host = _host_events(spark, sf)
    tracked = tracking.track(steps, src.plans(spark, sf), src.STEP_CAP, host)
    return tracking.transitions(tracked).select(
        "run_id", "step_index", "completed_subgoal_id", "completed_status", "trigger_reason",
        "next_subgoal_id", "from_host",
    )


@query(
    "f5_subgoal_state",
    rec(src.STEPS_SQL, FOLD_SQL, STATE_SQL) + f"""SELECT run_id, step_index,
       format('subgoal_{{:03d}}', active + 1) AS current_subgoal_id,
       CASE WHEN k >= {_N} THEN last_ended ELSE 'in_progress' END AS status,
       in_subgoal AS steps_in_current_subgoal, completed AS completed_subgoals_count,
       stalled AS stalled_advanced_subgoals_count, failed AS failed_subgoals_count,
       {_N} AS total_subgoals_count, {_RATIO}::DOUBLE AS subgoal_progress_ratio, active AS active_subgoal_index
    FROM states""",
)
def f5(spark, sf):
    steps = src.stored_steps(spark, sf)
    tracked = tracking.track(steps, src.plans(spark, sf), src.STEP_CAP)
    return tracking.subgoal_state(steps, tracked).select("run_id", "step_index", "state.*").drop(
        "current_subgoal_description", "time_in_current_subgoal_seconds", "abandoned_subgoals_count",
        "is_fallback",
    )


_TOTALS_SQL = f"""totals AS (SELECT run_id, count(*) FILTER (ended = 'completed') AS completed,
  count(*) FILTER (ended = 'stalled_advanced') AS stalled, count(*) FILTER (ended = 'failed') AS failed,
  {_N} - count(ended) AS abandoned FROM folded GROUP BY run_id)"""


@query(
    "f6_finalize_subgoals",
    rec(src.STEPS_SQL, FOLD_SQL, _TOTALS_SQL) + f"""SELECT run_id, {_N} AS total_subgoals, completed AS completed_count,
       stalled AS stalled_advanced_count, failed AS failed_count, abandoned AS abandoned_count, FALSE AS is_fallback FROM totals""",
)
def f6(spark, sf):
    return tracking.finalize(_tracked(spark, sf))


@query(
    "f7_drift",
    rec(*_FULL[:-2]) + """SELECT run_id, step_index, drifted AS drift_detected, score AS severity_score,
       level AS severity_level, signals, reasons FROM drifts""",
)
def f7(spark, sf):
    return _checked(spark, sf).select(
        "run_id", "step_index", "drift.drift_detected", "drift.severity_score", "drift.severity_level",
        F.array_join("drift.triggered_signals", ",").alias("signals"),
        F.array_join("drift.reasons", "; ").alias("reasons"),
    )


_ENDS_SQL = f"""ends AS (SELECT t.*, c.n AS total_steps, c.m AS n_matches FROM totals t JOIN
  (SELECT run_id, count(*) AS n, count(m_cat) AS m FROM matched GROUP BY run_id) c ON c.run_id = t.run_id)"""
_FINAL_SQL = drift_sql(
    "finals", "ends", "stalled", "failed", f"(completed / {_N})", "0", "total_steps", "n_matches", "'final'"
)


@query(
    "f8_drift_final",
    rec(*_CHAIN, FOLD_SQL, _TOTALS_SQL, _ENDS_SQL, _FINAL_SQL) + """SELECT run_id, drifted AS drift_detected,
       score AS severity_score, level AS severity_level, signals FROM finals""",
)
def f8(spark, sf):
    steps = src.stored_steps(spark, sf)
    counts = detectors.match_steps(steps, keys=KEYS, phrase="error").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_steps"), F.count_if(F.col("match").isNotNull()).alias("n_matches")
    )
    totals = tracking.finalize(tracking.track(steps, src.plans(spark, sf), src.STEP_CAP))
    ended = drift.final(totals.join(counts, "run_id"))
    return ended.select(
        "run_id", "final_drift.drift_detected", "final_drift.severity_score", "final_drift.severity_level",
        F.array_join("final_drift.triggered_signals", ",").alias("signals"),
    )


@query(
    "f9_reflection_triggers",
    rec(src.STEPS_SQL, FOLD_SQL) + f"""SELECT run_id, n AS step_index,
       {_TRIGGER.replace('step_index', 'n')} AS trigger_type FROM folded
    WHERE n >= 0 AND ({_TRIGGER.replace('step_index', 'n')}) IS NOT NULL""",
)
def f9(spark, sf):
    steps = src.stored_steps(spark, sf)
    ended = tracking.transitions(tracking.track(steps, src.plans(spark, sf), src.STEP_CAP))
    return reflection.reflection_triggers(steps, ended)


@query(
    "f10_reflect",
    rec(*_FULL[:-1]) + """SELECT run_id, step_index, NOT revise AS plan_still_valid, revise AS revision_suggested,
       reasoning_text AS revision_reasoning, r_conf AS confidence FROM reflected""",
)
def f10(spark, sf):
    return _checked(spark, sf).select(
        "run_id", "step_index", "reflection.plan_still_valid", "reflection.revision_suggested",
        "reflection.revision_reasoning", "reflection.confidence",
    )


_EDGE_DRIFT = drift_sql(
    "edge_drifts", "(SELECT * FROM both_sides WHERE ended IS NOT NULL)", "stalled", "failed", _RATIO,
    "in_subgoal", "(step_index + 2)", "matches_so_far", "subgoal",
)
_EDGE_REFLECT = reflect_sql(
    "edges", "edge_drifts", "'subgoal_boundary'", "(step_index + 1)", "subgoal", False
)


@query(
    "f11_boundary_report",
    rec(*_CHAIN, FOLD_SQL, STATE_SQL, JOINED_SQL, _EDGE_DRIFT, _EDGE_REFLECT) + """
    SELECT run_id, step_index, ended AS subgoal_status, ended IN ('completed', 'stalled_advanced') AS checkpoint_passed,
           subgoal AS next_subgoal, score AS severity_score, revise AS revision_suggested, reasoning_text AS revision_reasoning
    FROM edges""",
)
def f11(spark, sf):
    return summary.boundary_report(_checked(spark, sf)).select(
        "run_id", "step_index", "subgoal_status", "checkpoint_passed", "next_subgoal",
        "boundary_drift.severity_score", "boundary_reflection.revision_suggested",
        "boundary_reflection.revision_reasoning",
    )


@query(
    "f12_first_match",
    with_(*_CHAIN, src.RUNS_SQL) + """
    SELECT r.run_id, min(m.step_index) FILTER (m.m_cat IS NOT NULL) AS root_cause_step_index,
           arg_min(m.m_cat, m.step_index) FILTER (m.m_cat IS NOT NULL) AS root_cause_error_type,
           CASE WHEN count(m.m_cat) > 0 THEN 'pattern_match' ELSE 'none' END AS root_cause_source
    FROM runs r LEFT JOIN matched m ON m.run_id = r.run_id GROUP BY r.run_id""",
)
def f12_first(spark, sf):
    """The match tier alone: first flagged step of each run, from the look-back rules."""
    return rootcause.root_cause(_matched(spark, sf), src.runs(spark, sf))


_CANDIDATES = """candidates AS (
  SELECT run_id, step_index, 1 AS tier, m_cat AS cat, 'pattern_match' AS source FROM verdicts WHERE m_cat IS NOT NULL
  UNION ALL
  SELECT run_id, step_index, 2, CASE WHEN contains(signals, 'PATTERN_REPETITION_DRIFT') THEN 'reflection_error'
    ELSE 'planning_error' END, 'drift_monitor' FROM verdicts WHERE m_cat IS NOT NULL OR drifted
  UNION ALL
  SELECT run_id, step_index, 3, 'planning_error', 'reflector' FROM verdicts WHERE revise),
causes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_index, tier) AS rn FROM candidates) WHERE rn = 1)"""


@query(
    "f12_root_cause",
    rec(*_FULL, _CANDIDATES, src.RUNS_SQL) + """SELECT r.run_id, c.step_index AS root_cause_step_index,
       c.cat AS root_cause_error_type, coalesce(c.source, 'none') AS root_cause_source
    FROM runs r LEFT JOIN causes c ON c.run_id = r.run_id""",
)
def f12(spark, sf):
    return rootcause.root_cause(_checked(spark, sf), src.runs(spark, sf))


_LATE = reflect_sql("late", "finals", "'run_end'", "(total_steps - 1)", "'final'", False)


@query(
    "f13_run_summary",
    rec(*_FULL, _CANDIDATES, _TOTALS_SQL, _ENDS_SQL, _FINAL_SQL, _LATE) + """
    , flags AS (SELECT run_id, count(*) FILTER (flagged) AS n_flagged FROM verdicts GROUP BY run_id)
    SELECT e.run_id, e.total_steps, e.n_matches, f.n_flagged, e.completed AS completed_count,
           e.stalled AS stalled_advanced_count, e.failed AS failed_count, e.abandoned AS abandoned_count,
           e.score AS final_score, e.reasoning_text AS final_reasoning,
           CASE WHEN c.source IS NULL AND e.revise THEN e.total_steps - 1 ELSE c.step_index END AS root_cause_step_index,
           CASE WHEN c.source IS NULL AND e.revise THEN 'reflector' ELSE coalesce(c.source, 'none') END AS root_cause_source
    FROM late e JOIN flags f ON f.run_id = e.run_id LEFT JOIN causes c ON c.run_id = e.run_id""",
)
def f13(spark, sf):
    steps = src.stored_steps(spark, sf)
    plans = src.plans(spark, sf)
    result = evaluate.evaluate_trajectories(
        steps, plans, SETTINGS, keys=KEYS, phrase="error", use_task=False
    )
    return result.runs.select(
        "run_id", "total_steps", "n_matches", "n_flagged", "completed_count", "stalled_advanced_count",
        "failed_count", "abandoned_count", F.col("final_drift.severity_score").alias("final_score"),
        F.col("final_reflection.revision_reasoning").alias("final_reasoning"),
        "root_cause_step_index", "root_cause_source",
    )


@query("f14_evaluate_with_patterns")
def f14(spark, sf):
    """Offline replay with the pattern layer: benchmark texts as patterns, documents as runs."""
    from stepscope.catalog import texts as text_queries
    from stepscope.operators import vectors

    docs = src.texts(spark, sf)
    steps = docs.select(
        F.col("doc_id").alias("run_id"), F.lit(0).alias("step_index"),
        F.col("text").alias("reasoning"), F.col("lang").alias("action_name"),
        F.lit("{}").alias("args_key"), F.lit("ok").alias("tool_response"),
    )
    plans = docs.select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("task_description"),
        F.col("text").alias("proposed_plan"),
    )
    result = evaluate.evaluate_trajectories(
        steps, plans, Settings(), text_queries._patterns(spark, sf), vectors.idf_table(docs),
        use_task=False,
    )
    return result.runs.select(
        "run_id", "n_matches", "root_cause_step_index", "root_cause_error_type", "root_cause_source"
    )


# ---- payloads over steps ----

@query(
    "g13_judge_payload",
    with_(src.STEPS_SQL) + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM steps)
    SELECT run_id, step_index, action_name,
       '{{"k":"' || json_extract_string(args_key, '$.k') || '"}}' AS action_args, tool_response, n AS total_steps FROM sized
    WHERE n <= 6 OR step_index < 3 OR step_index >= n - 3 OR {contains_sql('lower(tool_response)', tx.SIGNAL_WORDS)}""",
)
def g13(spark, sf):
    return judging.payload_steps(src.stored_steps(spark, sf)).drop("reasoning")


def _score(payload: str) -> dict:
    """A scorer without a model: the number of steps in the payload picks the answer."""
    n = len(json.loads(payload)["steps"])
    return {
        "root_cause_error_type": tx.TAGS[n % len(tx.TAGS)],
        "root_cause_step_index": n % 5,
        "confidence": 0.5,
        "root_cause_justification": f"payload of {n} steps",
    }


@query(
    "g15_judge_batch",
    with_(src.STEPS_SQL) + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM steps),
    chosen AS (SELECT run_id, step_index // 1024 AS part, count(*) AS k FROM sized
      WHERE n <= 6 OR step_index < 3 OR step_index >= n - 3 OR {contains_sql('lower(tool_response)', tx.SIGNAL_WORDS)}
      GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k % 5, part) AS rn FROM chosen)
    SELECT run_id::VARCHAR AS run_id, ({tx.TAGS})[k % {len(tx.TAGS)} + 1] AS root_cause_error_type,
       (k % 5)::INT AS root_cause_step_index, 0.5::DOUBLE AS confidence,
       'payload of ' || k || ' steps' AS root_cause_justification FROM ranked WHERE rn = 1""",
)
def g15(spark, sf):
    payloads = judging.judge_payloads(src.stored_steps(spark, sf))
    return judging.one_judgment(judging.valid_answers(judging.judge_batch(payloads, _score)))


@query(
    "g13_long_arguments",
    """WITH cut AS (SELECT doc_id, lang, text, n_chars, length(text) AS n FROM documents)
    SELECT doc_id AS run_id, CASE WHEN n <= 150 THEN text
         ELSE substring(text, 1, 150) || '...[TRUNCATED, ' || n || ' chars total]' END AS first_argument,
       lang AS second_argument, n_chars::VARCHAR AS third_argument FROM cut""",
)
def g13_arguments(spark, sf):
    """Documents as arguments of one step each: every name stays, each value is cut by itself."""
    steps = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.lit(0).alias("step_index"), F.lit("").alias("reasoning"),
        F.lit("look").alias("action_name"), F.lit("ok").alias("tool_response"),
        F.to_json(F.struct(F.col("text").alias("first"), F.col("lang").alias("second"), F.col("n_chars").alias("third"))).alias("args_key"),
    )
    found = F.from_json("action_args", "map<string,string>")
    return judging.payload_steps(steps).select(
        "run_id", *[found[n].alias(f"{n}_argument") for n in ("first", "second", "third")]
    )


def _score_some(payload: str) -> dict | None:
    """Like `_score`, but some payloads never get a category."""
    n = len(json.loads(payload)["steps"])
    return _score(payload) if n % 4 else {"root_cause_step_index": n}


@query(
    "g15_resumed_batch",
    with_(src.STEPS_SQL) + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM steps),
    chosen AS (SELECT run_id, step_index // 1024 AS part, count(*) AS k FROM sized
      WHERE n <= 6 OR step_index < 3 OR step_index >= n - 3 OR {contains_sql('lower(tool_response)', tx.SIGNAL_WORDS)}
      GROUP BY ALL)
    SELECT run_id::VARCHAR AS run_id, part::BIGINT AS part, (CASE WHEN k % 4 = 0 THEN 3 ELSE 1 END)::INT AS tries,
       k % 4 <> 0 AS valid, CASE WHEN k % 4 <> 0 THEN ({tx.TAGS})[k % {len(tx.TAGS)} + 1] END AS category FROM chosen""",
)
def g15_resumed(spark, sf):
    """Answers for half of the runs stand in the folder already when the job starts again."""
    payloads = keep(judging.judge_payloads(src.stored_steps(spark, sf)), "payloads")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    judging.resumable_batch(payloads.where("run_id % 2 = 0"), _score_some, folder, attempts=1)
    states = judging.resumable_batch(payloads, _score_some, folder)
    category = F.get_json_object("answer", "$.root_cause_error_type")
    return states.select("run_id", "part", "tries", "valid", category.alias("category"))


# ---- live windows ----

@query(
    "h2_idle_sessions",
    """WITH g AS (SELECT user_id AS session_id, ts, CASE WHEN lag(ts) OVER w IS NULL
              OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
              FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM g)
       SELECT session_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n_events
       FROM numbered GROUP BY session_id, part""",
)
def h2(spark, sf):
    events = src.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    return windows.idle_sessions(events, gap="6 hours").select(
        "session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events"
    )


@query(
    "h3_drop_replayed",
    "SELECT DISTINCT user_id AS session_id, event_id AS call_id FROM events",
)
def h3(spark, sf):
    events = src.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("call_id")
    )
    return windows.drop_replayed(events.unionByName(events))


@query(
    "h5_alerts",
    rec(*_FULL) + """SELECT run_id, step_index, category, confidence, warning,
       CASE WHEN trig IS NOT NULL THEN reasoning_text END AS suggestion FROM verdicts WHERE flagged""",
)
def h5(spark, sf):
    return windows.alerts(_checked(spark, sf))


@query(
    "h7_live_metrics",
    with_(src.STEPS_SQL, LOOK_SQL, MATCH_SQL) + """SELECT CAST(floor("timestamp" / 86400) AS BIGINT) AS day, count(*) AS n_steps,
       count(m_cat) AS n_flagged, count(*) FILTER (tool_response LIKE 'Error%') AS n_failed FROM matched GROUP BY day""",
)
def h7(spark, sf):
    rows = _matched(spark, sf).select(
        F.timestamp_seconds("timestamp").alias("ts"),
        F.col("match").isNotNull().alias("flagged"),
        tt.response_failed(F.col("tool_response")).alias("failed"),
    )
    return windows.live_metrics(rows, size="1 day").select(
        (F.unix_seconds("window_start") / 86400).cast("bigint").alias("day"), "n_steps", "n_flagged", "n_failed"
    )


@query(
    "h4_route_events",
    """SELECT user_id AS session_id, event_id, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'block_check'
          WHEN 'purchase' THEN 'summary' ELSE 'step_check' END AS route FROM events""",
)
def h4(spark, sf):
    routes = windows.route_events(
        _as_session_events(src.table(spark, sf, "events"))
    )
    merged = None
    for branch in routes.values():
        rows = branch.select(
            F.col("session_id").cast("long").alias("session_id"), F.col("seq").alias("event_id"), "route"
        )
        merged = rows if merged is None else merged.unionByName(rows)
    return merged


def _as_session_events(events):
    """Events as hook events: sign-ups prompt, views ask, clicks and errors report, purchases stop."""
    kind = (
        F.when(F.col("event_type") == "signup", "UserPromptSubmit")
        .when(F.col("event_type") == "view", "PreToolUse")
        .when(F.col("event_type") == "purchase", "Stop")
        .otherwise("PostToolUse")
    )
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), kind.alias("hook_event_name"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Buy the item "), "props")).alias("prompt"),
        F.lit("").alias("plan"), F.col("event_type").alias("tool_name"), F.col("props").alias("tool_input"),
        F.when(F.col("event_type") == "error", "Error: request failed").otherwise("ok").alias("tool_response"),
    )


def _stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of them.

    A glob that fits the table only: a stream's plain path has to be a folder.
    """
    schema = src.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _folder(spark, name):
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("h2_streamed_sessions", SQL["h2_idle_sessions"])
def h2_streamed(spark, sf):
    """Idle sessions of the events table read as a stream."""
    events = _stream(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    found = sinks.drained(windows.idle_sessions(events, gap="6 hours"), _folder(spark, "sessions"), "complete")
    return found.select(
        "session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events"
    )


@query("h3_streamed_replays", SQL["h3_drop_replayed"])
def h3_streamed(spark, sf):
    """Two streams with the same calls, as a client that resends its history."""
    events = _stream(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    once = windows.drop_replayed(events.unionByName(events))
    return sinks.drained(once, _folder(spark, "replays")).drop("ts")


@query(
    "h7_streamed_metrics",
    """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP, TIMESTAMP '1970-01-01')) // 86400000000 AS day, event_type,
       count(*) AS n_steps, count(*) FILTER (value > 40) AS n_flagged, count(*) FILTER (event_type = 'error') AS n_failed
       FROM events GROUP BY ALL""",
)
def h7_streamed(spark, sf):
    """Daily metrics by kind of the events table read as a stream."""
    rows = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.coalesce(F.col("value") > 40, F.lit(False)).alias("flagged"), (F.col("event_type") == "error").alias("failed"),
    )
    counted = windows.live_metrics(rows, size="1 day", by=["event_type"])
    found = sinks.drained(counted, _folder(spark, "metrics"), "complete")
    day = (F.unix_seconds("window_start") / 86400).cast("bigint").alias("day")
    return found.select(day, "event_type", "n_steps", "n_flagged", "n_failed")


@query("a10_streamed_log", SQL["a10_redacted_log_rows"])
def a10_streamed(spark, sf):
    """The session log fed by a stream: credentials masked, each micro-batch written once."""
    docs = _stream(spark, sf, "documents").select(
        F.lit("step").alias("type"), F.col("doc_id").alias("session_id"), F.struct("text", "source").alias("body")
    )
    rows = sinks.drained(tt.redact_frame(docs), _folder(spark, "log"))
    return rows.select("type", "session_id", F.md5("body.text").alias("text_md5"), "body.source")


@query("h1_stream_guard")
def h1(spark, sf):
    """The events table read as a stream, judged live, and the judged rows read back."""
    judged = guard.stream_guard(
        _as_session_events(_stream(spark, sf, "events")), SETTINGS, idle_seconds=6 * 3600.0, watermark="1 day",
        phrase="error", keys=KEYS,
    )
    folder = f"{checkpoint_folder(spark)}/live-{uuid.uuid4().hex}"
    running = (
        judged.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state").outputMode("append")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(
        "session_id", "kind", "seq", "step_index", "category", "confidence", "flagged", "warning"
    )
