"""Queries on predicted against true root causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.catalog import inputs as src
from stepscope.catalog.registry import query, with_
from stepscope.catalog.reshape import quoted
from stepscope.operators import detectors, evaluation, judging

_J = with_(src.JUDGED_SQL)
_HITS = """hits AS (SELECT *, root_cause_error_type = true_type AS hit,
  coalesce(abs(root_cause_step_index - true_step) = 0, FALSE) AS exact,
  coalesce(abs(root_cause_step_index - true_step) <= 1, FALSE) AS near FROM judged WHERE true_type IS NOT NULL)"""
_H = with_(src.JUDGED_SQL, _HITS)
_TAG_ROWS = "tags AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(tx.TAGS)) + ") AS t(tag_no, tag))"
_RATES = """rates AS (SELECT t.tag_no, t.tag, count(h.run_id) AS total, count(*) FILTER (h.hit) AS correct,
  coalesce(count(*) FILTER (h.hit) / nullif(count(h.run_id), 0), 0)::DOUBLE AS match_rate
  FROM tags t LEFT JOIN hits h ON h.true_type = t.tag GROUP BY t.tag_no, t.tag)"""


@query(
    "g1_attach_truth",
    _J + """SELECT run_id, root_cause_error_type, true_type, true_step,
       CASE WHEN true_type IS NULL THEN 'unknown' ELSE benchmark END AS benchmark,
       CASE WHEN true_type IS NULL THEN 0 ELSE total_steps END AS total_steps FROM judged""",
)
def g1(spark, sf):
    judged = src.judged(spark, sf)
    truth = judged.where("true_type IS NOT NULL").select(
        "run_id", "true_type", "true_step", "benchmark",
        F.when(F.col("n_chars") % 2 == 0, F.col("total_steps")).otherwise(0).alias("total_steps"),
        F.col("total_steps").alias("n_steps"),
    )
    return evaluation.attach_truth(judged.select("run_id", "root_cause_error_type"), truth)


@query(
    "g2_category_distribution",
    _J + """SELECT 'overall' AS benchmark, root_cause_error_type AS category, count(*) AS n FROM judged GROUP BY ALL
    UNION ALL SELECT benchmark, root_cause_error_type, count(*) FROM judged GROUP BY ALL""",
)
def g2(spark, sf):
    return evaluation.category_distribution(src.judged(spark, sf))


@query(
    "g3_position_buckets",
    _J + """SELECT root_cause_error_type AS category,
       count(*) FILTER (root_cause_step_index / total_steps < 0.33) AS early,
       count(*) FILTER (root_cause_step_index / total_steps >= 0.33 AND root_cause_step_index / total_steps <= 0.66) AS mid,
       count(*) FILTER (root_cause_step_index / total_steps > 0.66) AS late
    FROM judged WHERE total_steps > 0 GROUP BY ALL""",
)
def g3(spark, sf):
    return evaluation.position_buckets(src.judged(spark, sf))


def _marked(spark, sf):
    return src.judged(spark, sf).withColumn("suspected_corrupted_action", F.col("source") == "src3")


@query(
    "g4_accuracy_report",
    _J + """, views AS (SELECT 'including_corrupted' AS view, * FROM judged WHERE true_type IS NOT NULL
       UNION ALL SELECT 'excluding_corrupted', * FROM judged WHERE true_type IS NOT NULL AND source <> 'src3')
    SELECT view, coalesce(true_type, 'overall') AS category, count(*) AS total,
           count(*) FILTER (root_cause_error_type = true_type) AS correct,
           round(count(*) FILTER (root_cause_error_type = true_type) / count(*), 4) AS accuracy
    FROM views GROUP BY GROUPING SETS ((view, true_type), (view))""",
)
def g4(spark, sf):
    return evaluation.accuracy_report(_marked(spark, sf))


@query("g5_propagation_report")
def g5(spark, sf):
    """The report's frames as one table of (part, key, value)."""
    judged = src.judged(spark, sf)
    parts = evaluation.propagation_report(judged, src.stored_steps(spark, sf))
    rows = None
    for name, frame in parts.items():
        part = frame.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("body"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "g6_judge_metrics",
    _H + """SELECT count(*) AS total_evaluated, count(*) FILTER (hit) / count(*) AS category_accuracy,
       count(*) FILTER (exact) / count(*) AS step_exact_accuracy,
       count(*) FILTER (near) / count(*) AS step_within1_accuracy FROM hits""",
)
def g6(spark, sf):
    return evaluation.judge_metrics(src.judged(spark, sf))


_CELLS = ", ".join(f"count(*) FILTER (h.root_cause_error_type = '{t}') AS {t}" for t in tx.TAGS)


@query(
    "g7_confusion_matrix",
    with_(src.JUDGED_SQL, _HITS, _TAG_ROWS) + f"""SELECT t.tag AS true_tag, {_CELLS}
    FROM tags t LEFT JOIN hits h ON h.true_type = t.tag GROUP BY t.tag""",
)
def g7(spark, sf):
    return evaluation.confusion_matrix(src.judged(spark, sf))


@query(
    "g8_per_category_rates",
    with_(src.JUDGED_SQL, _HITS, _TAG_ROWS, _RATES) + "SELECT * FROM rates",
)
def g8(spark, sf):
    return evaluation.per_category_rates(src.judged(spark, sf))


@query(
    "g9_disagreements",
    _H + """SELECT run_id, benchmark, true_type AS true_category, root_cause_error_type AS pred_category,
       true_step, root_cause_step_index AS pred_step, md5(justification) AS justification FROM hits WHERE NOT hit""",
)
def g9(spark, sf):
    return evaluation.disagreements(src.judged(spark, sf)).withColumn(
        "justification", F.md5("justification")
    )


@query(
    "g9_worst_category",
    with_(src.JUDGED_SQL, _HITS, _TAG_ROWS, _RATES) + """, worst AS (SELECT tag FROM rates WHERE total > 0 ORDER BY match_rate, tag_no LIMIT 1)
    SELECT run_id, true_type AS true_category, root_cause_error_type AS pred_category FROM hits
    WHERE NOT hit AND true_type = (SELECT tag FROM worst) ORDER BY run_id LIMIT 5""",
)
def g9_worst(spark, sf):
    return evaluation.worst_category(src.judged(spark, sf)).select(
        "run_id", "true_category", "pred_category"
    )


def _confident(spark, sf):
    return src.judged(spark, sf).select(
        "run_id", F.when(F.col("true_type").isNotNull(), F.lit(1.0)).alias("tag_confidence")
    )


@query(
    "g10_holdout_sample",
    _J + """SELECT run_id FROM judged WHERE true_type IS NOT NULL AND run_id NOT IN (SELECT item_id FROM benchmark)
    ORDER BY md5(CAST(run_id AS VARCHAR) || ':42'), run_id LIMIT 30""",
)
def g10(spark, sf):
    tuning = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("run_id"))
    return evaluation.holdout_sample(_confident(spark, sf), 30, 42, tuning).select("run_id")


@query(
    "g11_select_ids",
    _J + """SELECT b.item_id AS pos, b.item_id * 40 AS run_id, j.run_id IS NOT NULL AS found, j.benchmark
    FROM benchmark b LEFT JOIN judged j ON j.run_id = b.item_id * 40""",
)
def g11(spark, sf):
    wanted = src.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("pos"), (F.col("item_id") * 40).alias("run_id")
    )
    runs = src.judged(spark, sf).select("run_id", "benchmark")
    return evaluation.select_ids(runs, wanted).orderBy("pos").select("pos", "run_id", "found", "benchmark")


@query(
    "g14_pending_runs",
    "SELECT doc_id AS run_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def g14(spark, sf):
    runs = src.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"))
    judged = src.table(spark, sf, "labels").select(F.col("doc_id").alias("run_id"))
    return evaluation.pending_runs(runs, judged)


_MODULES = [*tx.MODULE_TYPES, "unknown"]
_TYPES = [t for types in tx.MODULE_TYPES.values() for t in types] + ["no_error", "made_up"]
_FOUND_SQL = f"""found AS (SELECT doc_id AS run_id, CAST(1 + n_chars % 4 AS INTEGER) AS critical_step,
  ([{quoted(_MODULES)}])[doc_id % {len(_MODULES)} + 1] AS critical_module,
  ([{quoted(_TYPES)}])[n_chars % {len(_TYPES)} + 1] AS error_type,
  CAST(1 + doc_id % 3 AS INTEGER) AS attempts FROM documents)"""


def _found(spark, sf):
    docs = src.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("run_id"),
        (1 + F.col("n_chars") % 4).cast("int").alias("critical_step"),
        F.get(F.array(*[F.lit(m) for m in _MODULES]), (F.col("doc_id") % len(_MODULES)).cast("int")).alias("critical_module"),
        F.get(F.array(*[F.lit(t) for t in _TYPES]), (F.col("n_chars") % len(_TYPES)).cast("int")).alias("error_type"),
        (1 + F.col("doc_id") % 3).cast("int").alias("attempts"),
    )


_EARLY = "(run_id % 5 = 3 AND critical_step = 1 AND critical_module IN ('memory', 'reflection'))"


@query(
    "g16_parse_judgment",
    with_(_FOUND_SQL) + f"""SELECT run_id,
       (['json', 'trailing_comma', 'literal', 'salvaged', 'parse_error'])[run_id % 5 + 1] AS parse_stage,
       CASE WHEN run_id % 5 = 4 THEN 1 ELSE critical_step END AS critical_step,
       CASE WHEN run_id % 5 = 4 OR {_EARLY} THEN 'unknown' ELSE critical_module END AS critical_module,
       CASE WHEN run_id % 5 = 4 THEN 'parse_error' WHEN {_EARLY} THEN 'analysis_error' ELSE error_type END AS error_type,
       FALSE AS error_detected,
       CASE WHEN run_id % 5 = 4 THEN 'Failed to parse analysis'
            WHEN run_id % 5 = 3 THEN 'Parse error - partial extraction'
            WHEN run_id % 5 = 2 THEN 'No evidence provided' ELSE d.text END AS evidence,
       ([0.5, 0.5, 0.5, 0.3, 0.0])[run_id % 5 + 1]::DOUBLE AS confidence,
       CASE WHEN run_id % 5 < 2 THEN d.lang ELSE 'No root cause identified' END AS root_cause,
       'No reasoning provided' AS reasoning, 'No guidance provided' AS correction_guidance,
       CASE WHEN run_id % 5 < 2 THEN '[{{"a":{{"b":{{"c":{{"d":{{"e":[1]}}}}}}}}}}]' ELSE '[]' END AS cascading_effects
    FROM found f JOIN documents d ON d.doc_id = f.run_id""",
)
def g16(spark, sf):
    """Findings written out the ways a judge writes them, then read back.

    The evidence is a whole document where the answer is JSON, and an effect is nested
    six deep.
    """
    kind = F.col("run_id") % 5
    body = F.format_string(
        '"critical_step": %d, "critical_module": "%s", "error_type": "%s"',
        F.col("critical_step"), F.col("critical_module"), F.col("error_type"),
    )
    docs = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text")
    )
    said = F.to_json(F.struct(F.col("_text").alias("evidence"), F.col("_lang").alias("root_cause")))
    effects = F.lit('"cascading_effects": [{"a": {"b": {"c": {"d": {"e": [1]}}}}}]')
    plain = F.concat(body, F.lit(", "), F.substr(said, F.lit(2), F.length(said) - 2), F.lit(", "), effects)
    text = (
        F.when(kind == 0, F.concat(F.lit("{"), plain, F.lit("}")))
        .when(kind == 1, F.concat(F.lit("Here it is:\n```json\n{"), plain, F.lit(",}\n```")))
        .when(kind == 2, F.concat(F.lit("{"), F.translate(body, '"', "'"), F.lit("}")))
        .when(kind == 3, F.concat(F.lit("broken { "), F.regexp_replace(body, '"', "")))
        .otherwise(F.lit("no verdict"))
    )
    answers = _found(spark, sf).join(docs, "run_id").select("run_id", text.alias("answer"))
    return answers.select("run_id", judging.parse_judgment(F.col("answer")).alias("j")).select("run_id", "j.*")


_TAG_CASE = "CASE critical_module " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in tx.MODULE_TAG.items()) + " ELSE 'other' END"


@query(
    "g17_validate_critical",
    with_(_FOUND_SQL) + f"""SELECT run_id, {_TAG_CASE} AS category, greatest(critical_step - 1, 0) AS step_index,
       CASE WHEN critical_step = 1 AND critical_module IN ('memory', 'reflection')
            THEN CASE WHEN attempts > 2 THEN 'analysis_failure' ELSE 'retry' END ELSE 'ok' END AS status,
       CASE WHEN critical_step = 1 AND critical_module IN ('memory', 'reflection') AND attempts > 2
            THEN 'analysis_failure' ELSE error_type END AS error_type FROM found""",
)
def g17(spark, sf):
    return judging.validate_critical(_found(spark, sf)).select(
        "run_id", "category", "step_index", "status", "error_type"
    )


_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{m}', '{t}')" for i, (m, types) in enumerate(tx.MODULE_TYPES.items()) for t in types
) + ") AS t(no, module, kind))"


@query(
    "g18_valid_error_type",
    with_(_FOUND_SQL, _DIM) + """, homes AS (SELECT kind, arg_min(module, no) AS home FROM dim GROUP BY kind),
    marked AS (SELECT f.*, h.home, f.critical_module <> 'unknown' AS known,
      f.error_type = 'no_error' OR EXISTS (SELECT 1 FROM dim d WHERE d.module = f.critical_module AND d.kind = f.error_type) AS valid
      FROM found f LEFT JOIN homes h ON h.kind = f.error_type)
    SELECT run_id, error_type,
       CASE WHEN known AND NOT valid AND home IS NOT NULL THEN home ELSE critical_module END AS critical_module,
       CASE WHEN NOT known THEN 'unknown_module' WHEN valid THEN 'valid' WHEN home IS NOT NULL THEN 'moved'
            ELSE 'unknown_type' END AS type_status FROM marked""",
)
def g18(spark, sf):
    return judging.valid_error_type(_found(spark, sf)).select(
        "run_id", "error_type", "critical_module", "type_status"
    )


@query(
    "g19_calibrated_thresholds",
    with_(src.JUDGED_SQL, _HITS, _TAG_ROWS, _RATES) + """SELECT tag, CASE WHEN total = 0 THEN 0.50
       WHEN total < 5 OR match_rate < 0.50 THEN 0.40 WHEN match_rate < 0.75 THEN 0.25 ELSE 0.20 END::DOUBLE AS threshold FROM rates""",
)
def g19(spark, sf):
    return evaluation.calibrated_thresholds(evaluation.per_category_rates(src.judged(spark, sf)))


@query(
    "g20_critical_report",
    with_(src.JUDGED_SQL, _FOUND_SQL) + """SELECT j.run_id, j.total_steps, j.true_type IS NULL AS task_success,
       CASE WHEN j.true_type IS NOT NULL THEN 'Step ' || f.critical_step || ' - ' || f.critical_module || ':' || f.error_type END AS critical_at,
       CASE WHEN j.true_type IS NULL THEN 'Task succeeded - no critical error' END AS message
    FROM judged j LEFT JOIN found f ON f.run_id = j.run_id""",
)
def g20(spark, sf):
    runs = src.judged(spark, sf).select(
        "run_id", "total_steps", F.col("true_type").isNull().alias("task_success")
    )
    return judging.critical_report(runs, _found(spark, sf).drop("attempts"))


@query(
    "e16_step_summaries",
    with_(_FOUND_SQL) + """, notes AS (
      SELECT run_id, critical_step AS step, 'memory' AS module, error_type, attempts = 1 AS bad FROM found
      UNION ALL SELECT run_id, critical_step, 'planning', error_type, attempts <= 2 FROM found
      UNION ALL SELECT run_id, critical_step, 'system', error_type, critical_module = 'system' FROM found),
    grouped AS (SELECT run_id, step, count(*) FILTER (bad) AS n,
      string_agg(module || ':' || error_type, ', ' ORDER BY CASE module WHEN 'system' THEN 0 WHEN 'memory' THEN 1 ELSE 2 END) FILTER (bad) AS e
      FROM notes GROUP BY run_id, step)
    SELECT run_id, step, n AS n_errors, 'Step ' || step || ': ' ||
       CASE WHEN n > 0 THEN 'Errors detected - ' || e ELSE 'No errors detected' END AS step_summary FROM grouped""",
)
def e16(spark, sf):
    found = _found(spark, sf)

    def note(module, bad):
        return found.select(
            "run_id", F.col("critical_step").alias("step"), F.lit(module).alias("module"),
            "error_type", bad.alias("error_detected"),
        )

    notes = (
        note("memory", F.col("attempts") == 1)
        .unionByName(note("planning", F.col("attempts") <= 2))
        .unionByName(note("system", F.col("critical_module") == "system"))
    )
    return detectors.step_summaries(notes)
