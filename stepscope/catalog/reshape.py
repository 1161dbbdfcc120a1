"""Queries on reading, shaping and cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.catalog import inputs as src
from stepscope.catalog.registry import SQL, query, with_
from stepscope.functions import text as tt
from stepscope.operators import deltas, edits, ordered, pairing, quality, shaping
from stepscope.session import checkpoint_folder
from stepscope.sources import records, runs as run_source


def quoted(words) -> str:
    return ", ".join(tt.sql_text(w) for w in words)


def contains_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {tt.sql_text(w)})" for w in words) + ")"


_TOKEN_LINE = (r"(?i)(\btoken\s*[:=]\s*[\"'])([A-Za-z0-9_\-\.]{20,})([\"'])", "$1***REDACTED***$3")


def _redact_sql(col: str, extra=()) -> str:
    for pattern, replacement in [*tx.CREDENTIALS, *extra]:
        back = replacement.replace("$", "\\")
        col = f"regexp_replace({col}, '{pattern.replace(chr(39), chr(39) * 2)}', '{back}', 'g')"
    return col


# ---- sources ----

@query(
    "a4_validate_contract",
    """SELECT user_id AS run_id, min(user_id) % 5 <> 0 AS is_valid,
              CASE WHEN min(user_id) % 5 = 0
                   THEN 'missing: trial_number, horizon_level, total_steps_taken'
                   ELSE 'missing: horizon_level, total_steps_taken' END AS contract_warning
       FROM events GROUP BY user_id""",
)
def a4(spark, sf):
    users = src.table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.lit(1).alias("_x")
    )
    text = F.concat(
        F.lit('{"run_id": "'), F.col("run_id").cast("string"), F.lit('", "task_id": null, '),
        F.when(F.col("run_id") % 5 == 0, "").otherwise('"trial_number": 1, '),
        F.lit('"final_status": "fail"}'),
    )
    checked = run_source.validate_contract(users.withColumn("metadata", text))
    return checked.select("run_id", "is_valid", "contract_warning")


@query(
    "a5_merge_judgments",
    with_(src.JUDGED_SQL) + """, files AS (
      SELECT run_id, CAST(n_chars % 3 AS INTEGER) AS file_ordinal, root_cause_error_type,
             root_cause_step_index FROM judged
      UNION ALL
      SELECT run_id, CAST((n_chars + 1) % 3 AS INTEGER), true_type, true_step FROM judged)
    SELECT run_id, file_ordinal, root_cause_error_type, root_cause_step_index FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY file_ordinal) AS rn FROM files)
    WHERE rn = 1""",
)
def a5(spark, sf):
    judged = src.judged(spark, sf)
    one = judged.select(
        "run_id", (F.col("n_chars") % 3).cast("int").alias("file_ordinal"),
        "root_cause_error_type", "root_cause_step_index",
    )
    two = judged.select(
        "run_id", ((F.col("n_chars") + 1) % 3).cast("int").alias("file_ordinal"),
        F.col("true_type").alias("root_cause_error_type"),
        F.col("true_step").alias("root_cause_step_index"),
    )
    return records.merge_judgments(one.unionByName(two))


@query(
    "a8_clean_runs",
    with_(src.STEPS_SQL, src.RUNS_SQL) + """
    SELECT * FROM runs r WHERE NOT (total_steps_taken = 1 AND EXISTS (
      SELECT 1 FROM steps s WHERE s.run_id = r.run_id AND s.action_name = 'error'))""",
)
def a8(spark, sf):
    """Runs that a clean-run tree holds: no noise, first of each task and trial."""
    kept = quality.split_infra_noise(
        src.runs(spark, sf), src.steps(spark, sf), markers=["timeout happened"], code=None
    ).where(~F.col("infra_noise"))
    return quality.dedupe_runs(kept.drop("infra_noise"), ["task_id", "trial_number"], ["run_id"])


_ERROR_RUNS_SQL = """incoming AS (
  SELECT user_id AS run_id, 'error' AS final_status, CAST(count(*) AS INTEGER) AS total_steps_taken
  FROM events WHERE event_type = 'error' AND value > 40 GROUP BY user_id)"""


@query(
    "a9_upsert_runs",
    with_(src.RUNS_SQL, _ERROR_RUNS_SQL) + """
    SELECT run_id, final_status, total_steps_taken FROM incoming
    UNION ALL
    SELECT r.run_id, r.final_status, r.total_steps_taken FROM runs r
    WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.run_id = r.run_id)""",
)
def a9(spark, sf):
    return run_source.upsert_runs(*_versions(spark, sf))


def _versions(spark, sf):
    current = src.runs(spark, sf).select("run_id", "final_status", "total_steps_taken")
    events = src.table(spark, sf, "events")
    incoming = (
        events.where((F.col("event_type") == "error") & (F.col("value") > 40))
        .groupBy(F.col("user_id").alias("run_id"))
        .agg(F.lit("error").alias("final_status"), F.count(F.lit(1)).cast("int").alias("total_steps_taken"))
    )
    return current, incoming


@query("a9_upsert_table", SQL["a9_upsert_runs"])
def a9_table(spark, sf):
    """The same into a stored table, of which only the parts with incoming runs are rewritten."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    current, incoming = _versions(spark, sf)
    run_source.upsert_table(current, path)
    run_source.upsert_table(incoming, path)
    return run_source.read_table(spark, path)


@query(
    "a10_redacted_log_rows",
    f"""SELECT 'step' AS type, doc_id AS session_id, md5({_redact_sql('text')}) AS text_md5,
        source FROM documents""",
)
def a10(spark, sf):
    """Rows as the session log gets them: credentials masked in every text column."""
    docs = src.table(spark, sf, "documents").select(
        F.lit("step").alias("type"), F.col("doc_id").alias("session_id"),
        F.struct("text", "source").alias("body"),
    )
    masked = tt.redact_frame(docs)
    return masked.select("type", "session_id", F.md5("body.text").alias("text_md5"), "body.source")


@query(
    "a11_untagged_failures",
    with_(src.RUNS_SQL) + """, tags AS (
      SELECT DISTINCT 'task_' || CAST(user_id // 3 AS VARCHAR) AS task_id,
             CAST(user_id % 3 AS INTEGER) AS trial_number
      FROM events WHERE event_type = 'purchase' AND value > 60)
    SELECT r.run_id, r.task_id, r.trial_number, r.final_status FROM runs r
    WHERE r.final_status IN ('fail', 'timeout', 'error')
      AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.task_id = r.task_id AND t.trial_number = r.trial_number)""",
)
def a11(spark, sf):
    events = src.table(spark, sf, "events")
    tags = events.where((F.col("event_type") == "purchase") & (F.col("value") > 60)).select(
        F.concat(F.lit("task_"), F.floor(F.col("user_id") / 3).cast("string")).alias("task_id"),
        (F.col("user_id") % 3).cast("int").alias("trial_number"),
    ).distinct()
    return records.untagged_failures(src.runs(spark, sf), tags).select(
        "run_id", "task_id", "trial_number", "final_status"
    )


# ---- shaping ----

_STEPS_OF_CHAT = """ordered_messages AS (
  SELECT run_id, turn, role, text,
         lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
         lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
  FROM messages WINDOW w AS (PARTITION BY run_id ORDER BY turn)),
chat_steps AS (
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY turn) - 1 AS INTEGER) AS step_index,
         turn, text AS content,
         CASE WHEN next_role = 'user' THEN next_text END AS tool_response,
         CASE WHEN prev_role = 'user' THEN prev_text END AS current_input
  FROM ordered_messages WHERE role = 'assistant')"""

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

_PARSED = """cleaned AS (
  SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS bare,
         regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean
  FROM chat_steps),
parsed AS (
  SELECT *, regexp_extract(clean, '^(\\S+)', 1) AS first_word,
         regexp_extract(clean, '(?s)^\\S+\\s+(.*)$', 1) AS rest_words,
         regexp_matches(bare, '^[a-zA-Z0-9_\\-\\s]+\\[.*\\]$') AS bracketed
  FROM cleaned),
parsed_steps AS (
  SELECT run_id, step_index, turn, tool_response, current_input, content AS reasoning,
         CASE WHEN bracketed THEN trim(regexp_extract(bare, '^([a-zA-Z0-9_\\-\\s]+)\\[', 1))
              WHEN first_word <> '' AND length(first_word) <= 20 THEN lower(first_word)
              ELSE 'react_action' END AS action_name,
         CASE WHEN bracketed THEN 'query'
              WHEN first_word <> '' AND length(first_word) <= 20 THEN 'target'
              ELSE 'command' END AS arg_name,
         CASE WHEN bracketed THEN trim(regexp_extract(bare, '\\[(.*)\\]$', 1))
              WHEN first_word <> '' AND length(first_word) <= 20
              THEN CASE WHEN rest_words <> '' THEN rest_words ELSE clean END
              ELSE content END AS arg_value
  FROM parsed)"""


@query(
    "b1_messages_to_steps",
    with_(src.MESSAGES_SQL, _STEPS_OF_CHAT) + "SELECT * FROM chat_steps",
)
def b1(spark, sf):
    return shaping.messages_to_steps(src.messages(spark, sf))


@query(
    "b2_parse_assistant_message",
    with_(src.MESSAGES_SQL, _STEPS_OF_CHAT, _PARSED)
    + "SELECT run_id, turn, reasoning, action_name, arg_name, arg_value FROM parsed_steps",
)
def b2(spark, sf):
    said = src.messages(spark, sf).where(F.col("role") == "assistant")
    return said.select("run_id", "turn", shaping.assistant_parts(F.col("text")).alias("p")).select(
        "run_id", "turn", "p.*"
    )


def _json_notes(spark, sf):
    """Documents as annotated records: two notes, the later one wins on a shared step."""
    modules = F.array(*[F.lit(m) for m in tx.ANNOTATION_KEYS])
    types = F.array(*[F.lit(t) for t in _SUBTYPES])
    docs = src.table(spark, sf, "documents")

    def note(step, module, kind):
        return F.concat(
            F.lit('{"step": '), step.cast("string"), F.lit(', "'), module,
            F.lit('": {"failure_type": "'), kind, F.lit('"}}'),
        )

    one = note(1 + F.col("n_chars") % 3, F.get(modules, (F.col("n_chars") % 7).cast("int")),
               F.get(types, (F.col("doc_id") % 19).cast("int")))
    two = note(1 + F.col("doc_id") % 3, F.get(modules, (F.col("doc_id") % 7).cast("int")),
               F.get(types, (F.col("n_chars") % 19).cast("int")))
    return docs.select(
        F.col("doc_id").alias("run_id"),
        F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")).alias("step_annotations"),
    )


_SUBTYPES = [
    "hallucination", "memory_retrieval_failure", "over_simplification", "progress_misjudge",
    "outcome_misinterpretation", "causal_misattribution", "constraint_ignorance",
    "impossible_action", "plan_inefficient", " Inefficient_Plan", "misalignment",
    "invalid_action", "format_error", "parameter_error", "step_limit",
    "tool_execution_error", "llm_limit", "environment_error", "",
]
_PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{t}', '{tx.MODULE_TAG[m]}')"
    for m, types in tx.MODULE_TYPES.items() if m != "others" for t in types
) + ") AS t(module, subtype, tag))"
_TYPES_SQL = "([" + quoted(_SUBTYPES) + "])"
_MODULES_SQL = "([" + quoted(tx.ANNOTATION_KEYS) + "])"
_NORMAL_SQL = """(CASE lower(trim({m})) WHEN 'plan' THEN 'planning' ELSE lower(trim({m})) END = p.module
   AND CASE lower(trim({t})) WHEN 'plan_inefficient' THEN 'inefficient_plan' ELSE lower(trim({t})) END = p.subtype)"""


@query(
    "b3_step_error_map",
    with_(_PAIRS_SQL) + f""", notes AS (
      SELECT doc_id AS run_id, 0 AS pos, 1 + n_chars % 3 AS step,
             {_MODULES_SQL}[n_chars % 7 + 1] AS module, {_TYPES_SQL}[doc_id % 19 + 1] AS subtype FROM documents
      UNION ALL
      SELECT doc_id, 1, 1 + doc_id % 3, {_MODULES_SQL}[doc_id % 7 + 1], {_TYPES_SQL}[n_chars % 19 + 1] FROM documents),
    tagged AS (SELECT n.*, coalesce(p.tag, 'other') AS tag FROM notes n LEFT JOIN pairs p ON """
    + _NORMAL_SQL.format(m="n.module", t="n.subtype")
    + """) SELECT run_id, CAST(step AS INTEGER) AS step, arg_max(tag, pos) AS tag FROM tagged GROUP BY run_id, step""",
)
def b3(spark, sf):
    return shaping.step_error_map(_json_notes(spark, sf))


@query(
    "b4_map_taxonomy",
    with_(_PAIRS_SQL) + f""", typed AS (SELECT doc_id AS run_id, {_MODULES_SQL}[n_chars % 7 + 1] AS module,
       {_TYPES_SQL}[doc_id % 19 + 1] AS subtype FROM documents)
    SELECT d.run_id, d.module, d.subtype, coalesce(p.tag, 'other') AS tag
    FROM typed d LEFT JOIN pairs p ON """ + _NORMAL_SQL.format(m="d.module", t="d.subtype"),
)
def b4(spark, sf):
    docs = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.get(F.array(*[F.lit(m) for m in tx.ANNOTATION_KEYS]), (F.col("n_chars") % 7).cast("int")).alias("module"),
        F.get(F.array(*[F.lit(t) for t in _SUBTYPES]), (F.col("doc_id") % 19).cast("int")).alias("subtype"),
    )
    return shaping.map_taxonomy(docs)


@query(
    "b5_slow_progress",
    with_(src.MESSAGES_SQL) + """, tail AS (
      SELECT run_id, substring(text, 1, 200) AS head,
             row_number() OVER (PARTITION BY run_id ORDER BY turn DESC) AS rn,
             count(*) OVER (PARTITION BY run_id) AS n
      FROM messages WHERE role = 'assistant'),
    rated AS (SELECT run_id, max(n) AS n, count(*) AS w, count(DISTINCT head) AS d
              FROM tail WHERE rn <= 10 GROUP BY run_id)
    SELECT m.run_id, coalesce(max(r.n), 0) AS n_texts,
           CASE WHEN coalesce(max(r.n), 0) < 2 THEN TRUE ELSE max(r.d) / max(r.w) > 0.5 END AS slow_progress
    FROM messages m LEFT JOIN rated r ON m.run_id = r.run_id GROUP BY m.run_id""",
)
def b5(spark, sf):
    return shaping.slow_progress(src.messages(spark, sf), minimum=2)


@query(
    "b6_convert_records",
    with_(_PAIRS_SQL) + f""", typed AS (
      SELECT *, {_MODULES_SQL}[n_chars % 7 + 1] AS m, {_TYPES_SQL}[doc_id % 19 + 1] AS t FROM documents),
    named AS (SELECT *, CASE m WHEN 'plan' THEN 'planning' ELSE m END AS nm,
      CASE lower(trim(t)) WHEN 'plan_inefficient' THEN 'inefficient_plan' ELSE lower(trim(t)) END AS nt FROM typed)
    SELECT '1.0' AS schema_version, CAST(doc_id AS VARCHAR) AS run_id, lang AS task_id, 1 AS trial_number,
           'fail' AS final_status, CAST(1 + n_chars % 40 AS INTEGER) AS total_steps_taken,
           greatest(doc_id % 5 - 1, 0) AS root_cause_step_index,
           coalesce(p.tag, 'other') AS root_cause_error_type,
           CASE WHEN nt <> '' THEN 1.0 END::DOUBLE AS tag_confidence,
           'agenterrorbench_import' AS tag_source, 'agenterrorbench' AS source_dataset,
           'train' AS source_split, source AS source_llm_model, nm AS original_module,
           nullif(nt, '') AS original_subtype, nt = '' AS original_subtype_missing,
           CASE WHEN nt = 'step_limit' THEN TRUE END AS likely_root_cause_was_inefficient_planning,
           CAST(NULL AS VARCHAR) AS reject_reason
    FROM named n LEFT JOIN pairs p ON p.module = n.nm AND p.subtype = n.nt""",
)
def b6(spark, sf):
    """Documents as benchmark records; their conversation is the chat of the same number."""
    modules = F.array(*[F.lit(m) for m in tx.ANNOTATION_KEYS])
    types = F.array(*[F.lit(t) for t in _SUBTYPES])
    docs = src.table(spark, sf, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("trajectory_id"),
        F.col("lang").alias("task_type"),
        F.col("source").alias("llm_model"),
        (1 + F.col("n_chars") % 40).cast("int").alias("num_steps"),
        F.array(F.get(modules, (F.col("n_chars") % 7).cast("int"))).alias("failure_modules"),
        F.array(F.get(types, (F.col("doc_id") % 19).cast("int"))).alias("failure_types"),
        F.array("source").alias("failure_reasonings"),
        F.lit("planning").alias("critical_failure_module"),
        (F.col("doc_id") % 5).cast("int").alias("critical_failure_step"),
        F.to_json(
            F.struct(F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"))
        ).alias("full_trajectory"),
    )
    return shaping.convert_records(rows, "train").drop("grader_notes")


@query(
    "b8_durations",
    """WITH g AS (SELECT user_id AS run_id, epoch_us(ts) / 1e6 AS s,
              epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
              FROM events)
       SELECT run_id, count(*) AS stamped_steps,
              CASE WHEN max(s) - min(s) > 0 THEN round(max(s) - min(s), 2) END AS duration_seconds,
              CASE WHEN count(*) >= 2 THEN round(sum(CASE WHEN gap BETWEEN 0 AND 21600 THEN gap ELSE 0 END), 2) END
                AS active_duration_seconds
       FROM g GROUP BY run_id""",
)
def b8(spark, sf):
    return shaping.durations(src.stored_steps(spark, sf), gap_cap=6 * 3600.0)


@query(
    "b9_task_identity",
    """SELECT conv_id, turn,
              'antigravity:' || substring(sha1(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), 1, 12) AS task_id,
              substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500) AS task_description
       FROM conversations WHERE role = 'user'""",
)
def b9(spark, sf):
    asked = src.table(spark, sf, "conversations").where(F.col("role") == "user")
    return asked.select("conv_id", "turn", shaping.task_identity(F.col("text")).alias("t")).select(
        "conv_id", "turn", "t.task_id", "t.task_description"
    )


@query(
    "b10_map_termination",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'completed_unverified' END AS final_status
       FROM events""",
)
def b10(spark, sf):
    return src.table(spark, sf, "events").select(
        "event_id", shaping.map_termination(F.col("event_type")).alias("final_status")
    )


@query(
    "b11_parse_iso",
    "SELECT event_id, epoch_us(ts) / 1e6 AS epoch_seconds FROM events",
)
def b11(spark, sf):
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return src.table(spark, sf, "events").select(
        "event_id", tt.iso_epoch(stamp).alias("epoch_seconds")
    )


@query(
    "b12_redact",
    f"""SELECT doc_id, md5(t) AS text_md5, contains(t, '***REDACTED***') AS masked
        FROM (SELECT doc_id, {_redact_sql('text', [_TOKEN_LINE])} AS t FROM documents)""",
)
def b12(spark, sf):
    docs = src.table(spark, sf, "documents").select(
        "doc_id", tt.redact(F.col("text"), [_TOKEN_LINE]).alias("t")
    )
    return docs.select("doc_id", F.md5("t").alias("text_md5"), F.col("t").contains("***REDACTED***").alias("masked"))


def _args_json(name: str, value: str) -> str:
    return f"'{{\"' || {name} || '\":' || CAST(to_json({value}) AS VARCHAR) || '}}'"


@query(
    "b13_to_detector_shape",
    with_(src.MESSAGES_SQL, _STEPS_OF_CHAT, _PARSED) + f"""
    SELECT run_id, step_index + 1 AS step,
           reasoning || chr(10) || '<action>' || action_name || '[' || {_args_json('arg_name', 'arg_value')} || ']</action>' AS content,
           coalesce(tool_response, '') AS env_response,
           coalesce(lag(tool_response) OVER (PARTITION BY run_id ORDER BY step_index), '') AS current_input
    FROM parsed_steps""",
)
def b13(spark, sf):
    steps = shaping.parse_steps(shaping.messages_to_steps(src.messages(spark, sf)))
    return shaping.to_detector_shape(steps)


@query(
    "b14_task_text_fallback",
    with_(src.MESSAGES_SQL, _STEPS_OF_CHAT) + """
    SELECT run_id, CASE WHEN trim(coalesce(tool_response, '')) <> '' THEN tool_response
                        ELSE coalesce(content, '') END AS task_description
    FROM chat_steps WHERE step_index = 0""",
)
def b14(spark, sf):
    steps = shaping.parse_steps(shaping.messages_to_steps(src.messages(spark, sf)))
    return shaping.task_text_fallback(steps)


@query(
    "b15_task_from_chat",
    """WITH asked AS (
         SELECT conv_id AS run_id, turn,
                list_filter(string_split('your task of ' || text, chr(10)),
                            lambda s: regexp_matches(lower(s), 'task|put|find'))[1] AS line,
                contains(lower('your task of ' || text), 'find') AS hinted
         FROM conversations WHERE role = 'user')
       SELECT run_id, coalesce(arg_max(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), turn) FILTER (hinted), '') AS task_description
       FROM asked GROUP BY run_id""",
)
def b15(spark, sf):
    chat = src.messages(spark, sf).withColumn(
        "text", F.concat(F.lit("your task of "), F.col("text"))
    )
    return shaping.task_from_chat(chat)


@query(
    "b16_extract_modules",
    """SELECT page_id,
         regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') AS memory,
         regexp_replace(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '^\\s+|\\s+$', '', 'g') AS reflection,
         regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '^\\s+|\\s+$', '', 'g') AS planning,
         regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '^\\s+|\\s+$', '', 'g') AS action
       FROM pages""",
)
def b16(spark, sf):
    tags = {"memory": "title", "reflection": "nav", "planning": "h1", "action": "p"}
    pages = src.table(spark, sf, "pages")
    return pages.select(
        "page_id", shaping.extract_modules(F.col("html"), F.lit("alfworld"), tags).alias("m")
    ).select("page_id", "m.*")


@query(
    "b17_pair_tool_calls",
    """WITH numbered AS (
         SELECT user_id AS session_id, event_id, event_type, props,
                json_extract_string(props, '$.k') AS call_id FROM events),
       results AS (
         SELECT session_id, call_id, min(event_id) AS result_seq FROM numbered
         WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
       linked AS (
         SELECT r.session_id, r.call_id, r.result_seq, max(c.event_id) AS call_seq
         FROM results r JOIN numbered c ON c.session_id = r.session_id AND c.call_id = r.call_id
              AND c.event_type IN ('click', 'view', 'signup') AND c.event_id < r.result_seq
         GROUP BY ALL)
       SELECT session_id, call_id, result_seq, call_seq FROM linked""",
)
def b17(spark, sf):
    """Pairs made by id; clicks, views and sign-ups call, purchases and errors answer."""
    calls, results = _calls_and_results(spark, sf)
    paired = pairing.pair_tool_calls(calls, results).where(F.col("paired_by") == "id")
    by_seq = calls.select(
        "session_id", F.col("args").alias("args_key"), F.col("call_seq")
    )
    return paired.join(by_seq, ["session_id", "args_key"]).select(
        "session_id", "call_id", "result_seq", "call_seq"
    )


def _calls_and_results(spark, sf):
    events = src.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "event_type",
        F.get_json_object("props", "$.k").alias("call_id"),
    )
    calls = events.where(F.col("event_type").isin("click", "view", "signup")).select(
        "session_id", F.col("event_id").alias("call_seq"), "call_id",
        F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("args"),
        F.lit("").alias("reasoning"),
    )
    results = events.where(F.col("event_type").isin("purchase", "error")).select(
        "session_id", F.col("event_id").alias("result_seq"), "call_id",
        F.lit("").alias("name"), F.col("event_type").alias("content"),
    )
    return calls, results


@query("b17_pair_tool_calls_steps")
def b17_steps(spark, sf):
    return pairing.pair_tool_calls(*_calls_and_results(spark, sf))


@query(
    "b18_assemble_deltas",
    """SELECT conv_id AS response_id, string_agg(text, '' ORDER BY turn) AS content,
              arg_max(role, turn) AS finish_reason, count(*) AS n_chunks
       FROM conversations GROUP BY conv_id""",
)
def b18(spark, sf):
    turns = src.table(spark, sf, "conversations")
    lines = turns.select(
        F.col("conv_id").alias("session_id"), F.col("conv_id").alias("response_id"),
        F.col("turn").alias("seq"),
        F.concat(
            F.lit("data: "),
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            F.col("role").alias("finish_reason"),
                            F.struct(F.col("text").alias("content")).alias("delta"),
                        )
                    ).alias("choices")
                )
            ),
        ).alias("line"),
    )
    return deltas.assemble_deltas(deltas.parse_chunks(lines)).select(
        "response_id", "content", "finish_reason", "n_chunks"
    )


@query(
    "b19_extract_text_edits",
    """SELECT doc_id, 0 AS edit_no, source || '.py' AS path, 'diff' AS format, lang AS search,
              md5(text) AS replace_md5 FROM documents""",
)
def b19(spark, sf):
    """Each document as a reply that rewrites a file named after it."""
    docs = src.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("Edit the file "), F.col("source"), F.lit(".py:\n<<<<<<< SEARCH\n"),
            F.col("lang"), F.lit("\n=======\n"), F.col("text"), F.lit("\n>>>>>>> REPLACE\n"),
        ).alias("text"),
    )
    found = edits.extract_text_edits(docs, ["doc_id"])
    return found.select(
        "doc_id", "edit_no", "path", "format", "search", F.md5("replace").alias("replace_md5")
    )


_PLACEHOLDERS_SQL = contains_sql("lower(text)", tx.PLACEHOLDER_PHRASES)


@query(
    "b20_select_task",
    f"""WITH m AS (SELECT conv_id AS run_id, turn, role,
               regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
       ranked AS (
         SELECT run_id, turn, text, role,
                CASE WHEN role = 'user' THEN
                  CASE WHEN NOT regexp_matches(lower(string_split(text, chr(10))[1]), '^({"|".join(tx.TEST_OUTPUT_PREFIXES)})')
                       AND NOT {_PLACEHOLDERS_SQL}
                       AND lower(text) NOT IN ({quoted(tx.PLACEHOLDER_TEXTS)}) THEN 3 ELSE 2 END
                ELSE 1 END AS rank
         FROM m WHERE text <> '' AND role IN ('user', 'system'))
       SELECT run_id, arg_max(text, rank * 1000000 + CASE WHEN role = 'user' THEN turn ELSE 1000 - turn END) AS task_description
       FROM ranked GROUP BY run_id""",
)
def b20(spark, sf):
    return shaping.select_task(src.messages(spark, sf))


@query(
    "b21_parse_args",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n_args,
              event_type AS raw_text, '[' || CAST(event_id AS VARCHAR) || ']' AS listed FROM events""",
)
def b21(spark, sf):
    """Object, plain text and list arguments of the same event."""
    events = src.table(spark, sf, "events")
    as_list = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))
    parsed = tt.parse_args(F.col("props"))
    return events.select(
        "event_id",
        F.element_at(parsed, "k").alias("k"),
        F.size(parsed).alias("n_args"),
        F.element_at(tt.parse_args(F.col("event_type")), "raw").alias("raw_text"),
        F.element_at(tt.parse_args(as_list), "args").alias("listed"),
    )


_PLAN_WORDS = ["\n", "ther", "tion."]


@query(
    "b22_detect_plan_text",
    f"""SELECT conv_id AS run_id, min(turn) AS turn, arg_min(text, turn) AS proposed_plan
        FROM conversations
        WHERE contains(text, chr(10)) OR contains(text, 'ther') OR contains(text, 'tion.') GROUP BY conv_id""",
)
def b22(spark, sf):
    return shaping.detect_plan_text(src.messages(spark, sf), _PLAN_WORDS)


@query(
    "b23_flatten_content",
    """SELECT conv_id, turn, text || chr(10) || role AS as_parts, text AS as_text FROM conversations""",
)
def b23(spark, sf):
    """Content as a list with a text part, an image part and a plain string; and as text."""
    parts = F.concat(
        F.lit("["),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))),
        F.lit(', {"type": "image", "url": "x"}, "'), F.col("role"), F.lit('"]'),
    )
    return src.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        shaping.flatten_content(parts).alias("as_parts"),
        shaping.flatten_content(F.col("text")).alias("as_text"),
    )


@query(
    "b7_transcript_to_steps",
    """WITH lines AS (
         SELECT user_id AS run_id, row_number() OVER w - 1 AS turn, epoch_us(ts) / 1e6 AS "timestamp",
                event_type, props, lead(event_type) OVER w AS following
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn) - 1 AS step_index, turn,
              "timestamp", event_type AS reasoning, event_type AS action_name,
              '{"k":"' || json_extract_string(props, '$.k') || '"}' AS action_args,
              CASE WHEN following IN ('error', 'purchase') THEN following END AS tool_response
       FROM lines WHERE event_type IN ('click', 'view')""",
)
def b7(spark, sf):
    """Events as a transcript: clicks and views plan, errors and purchases answer them."""
    events = src.table(spark, sf, "events")
    plans = F.col("event_type").isin("click", "view")
    lines = events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        F.when(plans, "PLANNER_RESPONSE")
        .when(F.col("event_type") == "signup", "USER_INPUT")
        .otherwise("GENERIC")
        .alias("type"),
        F.when(F.col("event_type") == "signup", "USER").otherwise("MODEL").alias("source"),
        F.col("event_type").alias("content"),
        F.lit(None).cast("string").alias("thinking"),
        F.when(
            plans,
            F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("args"))),
        ).alias("tool_calls"),
    )
    steps = shaping.transcript_to_steps(lines)
    return steps.withColumn("action_args", F.to_json("action_args"))


# ---- cleaning ----

@query(
    "c1_audit_runs",
    with_(src.STEPS_SQL, src.RUNS_SQL) + """
    SELECT r.run_id, count(s.run_id) AS n_steps,
           coalesce(bool_or(contains(lower(s.args_key), '"k": 42}')), FALSE) AS contaminated
    FROM runs r LEFT JOIN steps s ON r.run_id = s.run_id GROUP BY r.run_id""",
)
def c1(spark, sf):
    audited = quality.audit_runs(
        src.runs(spark, sf), src.steps(spark, sf), markers=['"k": 42}'], code=None
    )
    return audited.select("run_id", "n_steps", "contaminated")


@query(
    "c2_split_infra_noise",
    with_(src.STEPS_SQL, src.RUNS_SQL) + """
    SELECT r.run_id,
           coalesce(bool_or(contains(lower(s.args_key), '"k": 7}') OR regexp_matches(s.args_key, '\\b99\\b')
                            OR regexp_matches(s.tool_response, '\\b99\\b')), FALSE)
           OR regexp_matches(CAST(r.run_id AS VARCHAR), '\\b99\\b')
           OR regexp_matches(r.task_id, '\\b99\\b') AS infra_noise
    FROM runs r LEFT JOIN steps s ON r.run_id = s.run_id GROUP BY r.run_id, r.task_id""",
)
def c2(spark, sf):
    split = quality.split_infra_noise(
        src.runs(spark, sf), src.steps(spark, sf), markers=['"k": 7}'], code="99"
    )
    return split.select("run_id", "infra_noise")


@query(
    "c3_dedupe_runs",
    """SELECT user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
       WHERE rn = 1""",
)
def c3(spark, sf):
    events = src.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return quality.dedupe_runs(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "c4_flag_corrupted_action",
    with_(src.STEPS_SQL, src.RUNS_SQL) + """
    SELECT r.run_id, r.total_steps_taken // 2 AS root_cause_step_index,
           coalesce(s.action_name IN ('view', 'click'), FALSE) AS suspected_corrupted_action
    FROM runs r LEFT JOIN steps s ON r.run_id = s.run_id AND s.step_index = r.total_steps_taken // 2""",
)
def c4(spark, sf):
    truth = src.runs(spark, sf).select(
        "run_id", F.floor(F.col("total_steps_taken") / 2).cast("int").alias("root_cause_step_index")
    )
    return quality.flag_corrupted_action(truth, src.steps(spark, sf), ["view", "click"])
