"""The given tables mapped onto runs, steps, messages, plans and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.operators import ordered
from stepscope.session import cut, spread, tune

PLAN_CYCLE = ["click", "view", "signup", "purchase", "view", "click"]
PLAN_ITEMS = 12
STEP_CAP = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn", "role", "text"
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: one run per user, ordered by time."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        F.col("event_type").alias("action_name"), F.col("props").alias("args_key"),
    )
    numbered = ordered.number_rows(events, "run_id", ["ts", "event_id"])
    return numbered.select(
        "run_id",
        "step_index",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.lit("").alias("reasoning"),
        "action_name",
        "args_key",
        F.when(F.col("action_name") == "error", "Error: request failed")
        .when(F.col("action_name") == "purchase", "success")
        .otherwise("ok")
        .alias("tool_response"),
    )


def stored_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps written once, as they lie in a step table.

    For operators that read their input several times: the numbering is then done
    once, and a lost executor costs a re-read only.
    """
    return cut(steps(spark, sf_dir))


def plan_text() -> str:
    words = [PLAN_CYCLE[i % len(PLAN_CYCLE)] for i in range(PLAN_ITEMS)]
    return "\n".join(f"{i + 1}. {w} {w} item {i}" for i, w in enumerate(words))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # The text hangs on the count so that it is parsed per run, not per event.
    return users.select(
        "run_id",
        F.lit("finish the purchase").alias("task_description"),
        F.when(F.col("_n") > 0, F.lit(plan_text())).alias("proposed_plan"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata from events: status from the kinds of events seen."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("run_id")).agg(
        F.concat(F.lit("task_"), F.floor(F.col("user_id") / 3).cast("string")).alias("task_id"),
        (F.col("user_id") % 3).cast("int").alias("trial_number"),
        F.when(F.count_if(F.col("event_type") == "error") * 4 > F.count(F.lit(1)), "fail")
        .when(F.count_if(F.col("event_type") == "purchase") > 0, "success")
        .otherwise("timeout")
        .alias("final_status"),
        F.count(F.lit(1)).cast("int").alias("total_steps_taken"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judgments with, for labelled ones, a true cause."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    tags = F.array(*[F.lit(t) for t in tx.TAGS])
    total = (F.lit(1) + F.col("n_chars") % 40).cast("int")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("run_id"),
        F.col("lang").alias("benchmark"),
        F.get(tags, (F.col("n_chars") % 7).cast("int")).alias("root_cause_error_type"),
        (F.col("doc_id") % total).cast("int").alias("root_cause_step_index"),
        F.when(F.col("labelled"), F.get(tags, (F.col("doc_id") % 7).cast("int"))).alias("true_type"),
        F.when(F.col("labelled"), (F.col("n_chars") % total).cast("int")).alias("true_step"),
        total.alias("total_steps"),
        F.col("text").alias("justification"),
        "source",
        "n_chars",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


# The same mappings in SQL, for the oracles.
STEPS_SQL = """steps AS (
  SELECT user_id AS run_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_index,
         epoch_us(ts) / 1e6 AS "timestamp", '' AS reasoning, event_type AS action_name,
         props AS args_key,
         CASE event_type WHEN 'error' THEN 'Error: request failed'
              WHEN 'purchase' THEN 'success' ELSE 'ok' END AS tool_response
  FROM events)"""

RUNS_SQL = """runs AS (
  SELECT user_id AS run_id, 'task_' || CAST(user_id // 3 AS VARCHAR) AS task_id,
         CAST(user_id % 3 AS INTEGER) AS trial_number,
         CASE WHEN count(*) FILTER (event_type = 'error') * 4 > count(*) THEN 'fail'
              WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'success'
              ELSE 'timeout' END AS final_status,
         CAST(count(*) AS INTEGER) AS total_steps_taken
  FROM events GROUP BY user_id)"""

_TAGS_SQL = "[" + ", ".join(f"'{t}'" for t in tx.TAGS) + "]"

JUDGED_SQL = f"""judged AS (
  SELECT d.doc_id AS run_id, d.lang AS benchmark,
         ({_TAGS_SQL})[d.n_chars % 7 + 1] AS root_cause_error_type,
         CAST(d.doc_id % (1 + d.n_chars % 40) AS INTEGER) AS root_cause_step_index,
         CASE WHEN l.doc_id IS NOT NULL THEN ({_TAGS_SQL})[d.doc_id % 7 + 1] END AS true_type,
         CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.n_chars % (1 + d.n_chars % 40) AS INTEGER) END AS true_step,
         CAST(1 + d.n_chars % 40 AS INTEGER) AS total_steps,
         d.text AS justification, d.source AS source, d.n_chars AS n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PLAN_SQL = "plan_items AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, 'subgoal_{i + 1:03d}', '{PLAN_CYCLE[i % len(PLAN_CYCLE)]}')" for i in range(PLAN_ITEMS)
) + ") AS t(no, id, word))"

MESSAGES_SQL = "messages AS (SELECT conv_id AS run_id, turn, role, text FROM conversations)"
