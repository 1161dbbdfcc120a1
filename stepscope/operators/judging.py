"""Payloads for a judge, its answers, and the checks on them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope import taxonomy as tx
from stepscope.functions import text as tt
from stepscope.operators import ordered

PART = 1024


def trimmed(col: Column, limit: int) -> Column:
    text = F.coalesce(col, F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(
            F.substring(text, 1, limit),
            F.format_string("...[TRUNCATED, %d chars total]", F.length(text)),
        )
    )


def shortened(col: Column, limit: int) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("...")))\
        .otherwise(col)


def trimmed_args(args: Column, cut: Callable[[Column], Column]) -> Column:
    """Argument JSON with each value cut on its own as text, every name kept.

    A null value is the text None. Text that is no JSON object is one argument, `args`.
    """
    parsed = F.from_json(args, "map<string,string>")

    def each(found: Column) -> Column:
        values = F.transform_values(
            found, lambda _, v: F.when(v.isNull(), F.lit("None")).otherwise(cut(v))
        )
        whole = F.create_map(F.lit("args"), cut(F.coalesce(args, F.lit(""))))
        return F.to_json(F.when(found.isNotNull(), values).otherwise(whole))

    return tt.let(parsed, each)


def payload_steps(
    steps: DataFrame, full: bool = False, edge: int = 3, fixed_limits: bool = False,
    block: int = ordered.BLOCK,
) -> DataFrame:
    """The steps a judge sees, trimmed.

    Runs of up to six steps are kept whole; of longer ones the first and last three
    and every step with a signal word. Arguments are JSON text, each value cut on its own.
    """
    sizes = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    longs = ordered.long_runs(steps, "run_id", "step_index", block)
    sized = ordered.join_runs(steps, sizes, how="inner", block=block, longs=longs)
    blob = F.lower(
        F.concat_ws(" ", F.coalesce("reasoning", F.lit("")), F.coalesce("tool_response", F.lit("")))
    )
    keep = (
        F.lit(full or fixed_limits)
        | (F.col("_n") <= 2 * edge)
        | (F.col("step_index") < edge)
        | (F.col("step_index") >= F.col("_n") - edge)
        | tt.contains_any(blob, tx.SIGNAL_WORDS)
    )

    def cut_text(name: str, limit: int, fixed: int) -> Column:
        if full:
            return F.coalesce(name, F.lit(""))
        return shortened(F.col(name), fixed) if fixed_limits else trimmed(F.col(name), limit)

    def cut_value(value: Column) -> Column:
        return value if full else shortened(value, 500) if fixed_limits else trimmed(value, 150)

    return sized.where(keep).select(
        "run_id",
        "step_index",
        cut_text("reasoning", 500, 800).alias("reasoning"),
        F.coalesce(F.nullif("action_name", F.lit("")), F.lit("none")).alias("action_name"),
        trimmed_args(F.col("args_key"), cut_value).alias("action_args"),
        cut_text("tool_response", 500, 800).alias("tool_response"),
        F.col("_n").alias("total_steps"),
    )


def judge_payloads(
    steps: DataFrame, runs: DataFrame | None = None, part: int = PART, **options
) -> DataFrame:
    """Payload JSON per run and part.

    A part covers up to `part` consecutive steps, so a payload row stays bounded; a run
    of ordinary length has one part. runs(run_id, task_id, task_description,
    final_status, grader_notes) adds the head.
    """
    chosen = payload_steps(steps, **options).withColumn("part", F.floor(F.col("step_index") / part))
    item = F.struct("step_index", "reasoning", "action_name", "action_args", "tool_response")
    rows = chosen.groupBy("run_id", "part").agg(
        F.max("total_steps").alias("total_steps"),
        F.array_sort(F.collect_list(item)).alias("steps"),  # at most `part` steps
    )
    if runs is not None:
        head = runs.select(
            "run_id", "task_id", "final_status",
            trimmed(F.coalesce("task_description", "task_id"), 300).alias("task_description"),
            trimmed(F.col("grader_notes"), 300).alias("grader_notes"),
        )
        rows = rows.join(head, "run_id", "left")
    body = F.struct(*[F.col(c) for c in rows.columns if c != "part"])
    return rows.select("run_id", "part", "total_steps", F.to_json(body).alias("payload"))


_ANSWER = "run_id string, part long, answer string, error string"


def judge_batch(
    payloads: DataFrame,
    scorer: Callable[[str], dict | None],
    requests: int | None = None,
    attempts: int = 1,
) -> DataFrame:
    """Send each payload to the caller's scorer; answers as JSON text, a row per part.

    The number of partitions is the number of requests in flight. A call that fails is
    made `attempts` times at most and then gives a row with `error`; it never ends the
    job. `one_judgment` brings the parts of a run together. A column `attempt` is handed on.
    """
    part = F.col("part") if "part" in payloads.columns else F.lit(0)
    kept = [c for c in ["attempt"] if c in payloads.columns]
    rows = payloads.select(
        F.col("run_id").cast("string").alias("run_id"), part.cast("long").alias("part"), "payload", *kept
    )
    if requests:
        rows = rows.repartition(requests)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for payload in batch["payload"]:
                answer, error = None, "no answer"
                for _ in range(attempts):
                    try:
                        found = scorer(payload)
                    except Exception as problem:  # one bad call must not lose the batch
                        error = str(problem)
                        continue
                    if found:
                        answer, error = json.dumps(found), None
                        break
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame(
                {"run_id": batch["run_id"], "part": batch["part"], "answer": answers, "error": errors}
                | {c: batch[c] for c in kept}
            )

    return rows.mapInPandas(call, _ANSWER + "".join(f", {c} int" for c in kept))


def no_category(answer: Column) -> Column:
    """Whether an answer lacks the category of a judgment."""
    return F.get_json_object(answer, "$.root_cause_error_type").isNull()


def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers kept in a folder: run_id, part, attempt, answer, error; one an attempt.

    A task that was started twice may have left an answer twice; the smaller one counts.
    """
    schema = f"{_ANSWER}, attempt int"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(folder)
    return rows.groupBy("run_id", "part", "attempt").agg(
        F.min(F.struct("answer", "error")).alias("a")
    ).select("run_id", "part", "attempt", "a.answer", "a.error")


def answer_states(answers: DataFrame, invalid: Callable[[Column], Column] = no_category) -> DataFrame:
    """The last answer of each payload, how often it was asked, and whether the answer is valid."""
    last = F.max_by(F.struct("answer", "error"), "attempt").alias("a")
    rows = answers.groupBy("run_id", "part").agg(last, F.max("attempt").alias("tries"))
    answer = F.col("a.answer")
    return rows.select(
        "run_id", "part", "tries", "a.answer", "a.error",
        (answer.isNotNull() & ~invalid(answer)).alias("valid"),
    )


def resumable_batch(
    payloads: DataFrame,
    scorer: Callable[[str], dict | None],
    folder: str,
    attempts: int = 3,
    invalid: Callable[[Column], Column] = no_category,
    tasks: int | None = None,
) -> DataFrame:
    """Ask about each payload until it has a valid answer, `attempts` times at most.

    Answers are appended to `folder`, which all executors share, and a task's answers stand
    there as soon as it ends. Started again after it was killed, the job asks only about
    payloads without a valid answer and with attempts left, so what ended is not asked
    twice; at most the payloads of the tasks that were running are. `tasks` sets how finely
    a round is cut. Returns `answer_states` of the payloads. Payloads need distinct
    (run_id, part); a folder belongs to one set of payloads.
    """
    spark = payloads.sparkSession
    part = F.col("part") if "part" in payloads.columns else F.lit(0)
    rows = payloads.select(
        F.col("run_id").cast("string").alias("run_id"), part.cast("long").alias("part"), "payload"
    )
    key = ["run_id", "part"]
    for _ in range(attempts):
        known = answer_states(stored_answers(spark, folder), invalid)
        done = known.where(F.col("valid") | (F.col("tries") >= attempts)).select(*key)
        tries = known.select(*key, F.col("tries").cast("int").alias("attempt"))
        pending = rows.join(done, key, "left_anti").join(tries, key, "left").withColumn(
            "attempt", F.coalesce("attempt", F.lit(0)) + 1
        )
        # Nothing is shuffled after an answer, and version 2 of the committer puts a task's
        # file into the folder when the task ends.
        judge_batch(pending, scorer, tasks).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2"
        ).parquet(folder)
    return answer_states(stored_answers(spark, folder), invalid).join(rows.select(*key), key, "left_semi")


def valid_answers(answers: DataFrame) -> DataFrame:
    """Answers with the judgment fields; rows without a category are left out."""
    fields = (
        "root_cause_error_type string, root_cause_step_index int, confidence double, "
        "root_cause_justification string"
    )
    return (
        answers.withColumn("j", F.from_json("answer", fields))
        .where(F.col("j.root_cause_error_type").isNotNull())
        .select("run_id", *[c for c in ["part"] if c in answers.columns], "j.*")
    )


def one_judgment(judgments: DataFrame) -> DataFrame:
    """One judgment per run: the most confident part's, on ties that with the earliest step."""
    sure = F.coalesce("confidence", F.lit(0.0))
    step = F.coalesce("root_cause_step_index", F.lit(2**31 - 1))
    fields = [c for c in judgments.columns if c not in ("run_id", "part")]
    part = F.col("part") if "part" in judgments.columns else F.lit(0)
    best = F.min_by(F.struct(*fields), F.struct(-sure, step, part))
    return judgments.groupBy("run_id").agg(best.alias("j")).select("run_id", "j.*")


_FIELDS = (
    "critical_step string, critical_module string, error_type string, error_detected string, "
    "root_cause string, evidence string, reasoning string, correction_guidance string, "
    "confidence double, cascading_effects string"
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced_objects(texts: pd.Series) -> pd.Series:
    """The outermost balanced {...} of each text, of any length and depth, in order.

    An opening brace that is never closed is passed over, what stands inside it is not.
    """

    def of(text: str | None) -> list[str]:
        opened: list[int] = []
        found: list[tuple[int, int]] = []
        for m in re.finditer("[{}]", text or ""):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                start = opened.pop()
                while found and found[-1][0] > start:
                    found.pop()
                found.append((start, m.end()))
        return [text[a:z] for a, z in found]

    return texts.map(of)


# What stands for a text that the judge did not give.
_TEXTS = {
    "root_cause": "No root cause identified",
    "reasoning": "No reasoning provided",
    "correction_guidance": "No guidance provided",
    "cascading_effects": "[]",
}


def parse_judgment(text: Column) -> Column:
    """Judge text as a struct with `parse_stage`.

    Tried in turn on each balanced `{...}`: JSON as it is, without trailing commas, with
    apostrophes mended, as Python literals; then single fields are searched for; else
    stage `parse_error`. `cascading_effects` is the JSON text of its value.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*```.*$", "")
    candidates = balanced_objects(bare)

    def read(c: Column, tolerant: bool) -> Column:
        quotes = "true" if tolerant else "false"
        return F.from_json(c, _FIELDS, {"allowSingleQuotes": quotes})

    def no_commas(c: Column) -> Column:
        return F.regexp_replace(c, r",(\s*[}\]])", "$1")

    def mended(c: Column) -> Column:
        return F.regexp_replace(no_commas(c), r'([a-zA-Z])"(s|t|ll|ve|re|d)\s', "$1'$2 ")

    def pythonish(c: Column) -> Column:
        low = F.regexp_replace(no_commas(c), r"\bTrue\b", "true")
        low = F.regexp_replace(low, r"\bFalse\b", "false")
        return F.regexp_replace(low, r"\bNone\b", "null")

    stages = [
        ("json", lambda c: c, False),
        ("trailing_comma", no_commas, False),
        ("mended_quotes", mended, False),
        ("literal", pythonish, True),
    ]

    def parse_one(c: Column) -> Column:
        tries = []
        for name, repair, tolerant in stages:
            parsed = read(repair(c), tolerant)
            tries.append(
                F.when(
                    F.coalesce(
                        parsed["error_type"], parsed["critical_module"], parsed["error_detected"]
                    ).isNotNull(),
                    F.struct(
                        F.lit(name).alias("parse_stage"),
                        F.coalesce(parsed["critical_step"].try_cast("int"), F.lit(1)).alias(
                            "critical_step"
                        ),
                        F.coalesce(parsed["critical_module"], F.lit("unknown")).alias(
                            "critical_module"
                        ),
                        F.coalesce(parsed["error_type"], F.lit("unknown")).alias("error_type"),
                        F.coalesce(
                            F.lower(parsed["error_detected"]).isin("true", "yes", "1"),
                            F.lit(False),
                        ).alias("error_detected"),
                        F.coalesce(parsed["evidence"], F.lit("No evidence provided")).alias(
                            "evidence"
                        ),
                        F.coalesce(parsed["confidence"], F.lit(0.5)).alias("confidence"),
                        *[F.coalesce(parsed[name], F.lit(text)).alias(name) for name, text in _TEXTS.items()],
                    ),
                )
            )
        return F.coalesce(*tries)

    parsed = F.get(
        F.filter(F.transform(candidates, parse_one), lambda p: p.isNotNull()), F.lit(0)
    )

    def salvage(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(bare, "(?i)" + pattern, 1), F.lit(""))

    step = salvage(r"(?:critical_step|step)[\"\s:]+(\d+)").try_cast("int")
    module = salvage(r"(?:critical_module|module)[\"\s:]+[\"']*([a-z_]+)")
    kind = salvage(r"error[_\s-]*type[^:]*:\s*[\"']?([^\"'\n\r,}]+)")
    detected = salvage(r"error[_\s-]*detected[^:]*:\s*([A-Za-z]+)")
    early = (step == 1) & module.isin("memory", "reflection")
    rescued = F.when(
        kind.isNotNull() | detected.isNotNull(),
        F.struct(
            F.lit("salvaged").alias("parse_stage"),
            F.coalesce(step, F.lit(1)).alias("critical_step"),
            F.when(early, "unknown").otherwise(F.coalesce(module, F.lit("unknown"))).alias(
                "critical_module"
            ),
            F.when(early, "analysis_error")
            .otherwise(F.coalesce(F.lower(tt.strip(kind)), F.lit("unknown")))
            .alias("error_type"),
            F.coalesce(F.lower(detected).isin("true", "yes", "1"), F.lit(False)).alias(
                "error_detected"
            ),
            F.lit("Parse error - partial extraction").alias("evidence"),
            F.lit(0.3).alias("confidence"),
            *[F.lit(text).alias(name) for name, text in _TEXTS.items()],
        ),
    )
    failed = F.struct(
        F.lit("parse_error").alias("parse_stage"),
        F.lit(1).alias("critical_step"),
        F.lit("unknown").alias("critical_module"),
        F.lit("parse_error").alias("error_type"),
        F.lit(False).alias("error_detected"),
        F.lit("Failed to parse analysis").alias("evidence"),
        F.lit(0.0).alias("confidence"),
        *[F.lit(text).alias(name) for name, text in _TEXTS.items()],
    )
    return F.coalesce(parsed, rescued, failed)


def validate_critical(rows: DataFrame, attempts: str = "attempts", retries: int = 2) -> DataFrame:
    """Check rows(run_id, critical_step, critical_module, error_type, attempts).

    Memory or reflection cannot fail at step 1: such a row is to be retried, and after
    the last attempt it becomes an analysis failure. Adds the tag and the step from 0.
    """
    bad = (F.col("critical_step") == 1) & F.col("critical_module").isin("memory", "reflection")
    spent = F.col(attempts) > retries
    tag = F.coalesce(
        *[F.when(F.col("critical_module") == m, F.lit(t)) for m, t in tx.MODULE_TAG.items()],
        F.lit("other"),
    )
    return (
        rows.withColumn(
            "status",
            F.when(bad & spent, "analysis_failure").when(bad, "retry").otherwise("ok"),
        )
        .withColumn("category", tag)
        .withColumn("step_index", F.greatest(F.col("critical_step") - 1, F.lit(0)))
        .withColumn(
            "error_type", F.when(bad & spent, "analysis_failure").otherwise(F.col("error_type"))
        )
        .withColumn(
            "critical_module", F.when(bad & spent, "unknown").otherwise(F.col("critical_module"))
        )
    )


def valid_error_type(rows: DataFrame) -> DataFrame:
    """Move a row to the module that knows its error type; `type_status` says what was done.

    rows(critical_module, error_type). The first module in definition order wins.
    """
    dim = tx.module_type_table(rows.sparkSession)
    own = dim.select(
        F.col("module").alias("_m"), F.col("error_type").alias("_t"), F.lit(True).alias("_own")
    )
    home = dim.groupBy(F.col("error_type").alias("_ht")).agg(
        F.min_by("module", "module_no").alias("_home")
    )
    known_module = F.col("critical_module").isin(*tx.MODULE_TYPES)
    valid = F.coalesce("_own", F.lit(False)) | (F.col("error_type") == "no_error")
    joined = rows.join(
        F.broadcast(own),  # 19 fixed rows
        (F.col("critical_module") == F.col("_m")) & (F.col("error_type") == F.col("_t")),
        "left",
    ).join(F.broadcast(home), F.col("error_type") == F.col("_ht"), "left")
    moved = known_module & ~valid & F.col("_home").isNotNull()
    return (
        joined.withColumn(
            "type_status",
            F.when(~known_module, "unknown_module")
            .when(valid, "valid")
            .when(moved, "moved")
            .otherwise("unknown_type"),
        )
        .withColumn(
            "critical_module", F.when(moved, F.col("_home")).otherwise(F.col("critical_module"))
        )
        .drop("_m", "_t", "_own", "_ht", "_home")
    )


def critical_report(runs: DataFrame, critical: DataFrame) -> DataFrame:
    """Per run: step total and its critical error, or none when the task succeeded.

    runs(run_id, total_steps, task_success), critical(run_id, critical_step,
    critical_module, error_type).
    """
    text = F.format_string(
        "Step %d - %s:%s", F.col("critical_step"), F.col("critical_module"), F.col("error_type")
    )
    failed = ~F.col("task_success") & F.col("critical_step").isNotNull()
    return runs.join(critical, "run_id", "left").select(
        "run_id",
        "total_steps",
        "task_success",
        F.when(failed, text).alias("critical_at"),
        F.when(F.col("task_success"), F.lit("Task succeeded - no critical error")).alias("message"),
    )
