"""Judgments, transcripts, tags, patterns, benchmark records and session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepscope import schemas
from stepscope import taxonomy as tx
from stepscope.functions import text as tt
from stepscope.operators import ordered, shaping


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)


def merge_judgments(judgments: DataFrame) -> DataFrame:
    """First file wins per run: judgments(run_id, file_ordinal, ...)."""
    return ordered.first_by(judgments, ["run_id"], [F.col("file_ordinal")])


def read_judgments(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Judged files {"judgments": {run_id: {...}}} merged; and the paths not found."""
    missing = [p for p in paths if not _exists(spark, p)]
    rows = None
    for number, path in enumerate(paths):
        if path in missing:
            continue
        parsed = F.from_json(
            "value", f"judgments map<string,struct<{schemas.JUDGMENT}>>"
        )["judgments"]
        part = (
            spark.read.option("wholetext", True).text(path)
            .select(F.explode(parsed).alias("run_id", "j"))
            .select(
                "run_id",
                "j.root_cause_error_type",
                "j.root_cause_step_index",
                "j.confidence",
                F.coalesce("j.justification", "j.root_cause_justification").alias("justification"),
                F.lit(number).alias("file_ordinal"),
            )
        )
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise FileNotFoundError(f"none of the judged files exists: {paths}")
    return merge_judgments(rows), missing


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines of JSONL files; blank and bad lines are dropped.

    The run is the file name without its suffix. Lines are numbered per file by
    their place in it, so that a large file may be split between tasks.
    """
    raw = spark.read.text(path).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("run_id"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    parsed = raw.withColumn("j", F.from_json("value", schemas.TRANSCRIPT)).where(
        F.json_object_keys("value").isNotNull() & F.col("j").isNotNull()
    )
    # Within a split the id grows with the line; splits are ordered by their start.
    return parsed.select("run_id", F.struct("_start", "_line").alias("_at"), "j.*").select(
        "run_id", (F.col("_at._start") * (1 << 20) + F.col("_at._line") % (1 << 33)).alias("line_no"),
        "created_at", "type", "source", "content", "thinking", "tool_calls",
    )


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern table or pattern file; a missing path gives no patterns.

    `pattern_no` is the order of the library. Rows with a category outside the taxonomy
    stay: `split_patterns` parts them from the others.
    """
    schema = schemas.PATTERN
    if not _exists(spark, path):
        return spark.createDataFrame([], f"pattern_no int, {schema}")
    if path.endswith(".json"):
        rows = (
            spark.read.option("wholetext", True).text(path)
            .select(
                F.posexplode(
                    F.from_json("value", f"patterns array<struct<{schema}>>")["patterns"]
                ).alias("pattern_no", "p")
            )
            .select("pattern_no", "p.*")
        )
    else:
        rows = spark.read.parquet(path)
    return rows.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(1.0)),
            "safe_alternative": F.coalesce("safe_alternative", F.lit("")),
        }
    )


def split_patterns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns of the taxonomy's categories, and the rejected others."""
    known = F.coalesce(F.col("category").isin(*tx.TAGS), F.lit(False))
    return rows.where(known), rows.where(~known)


def write_patterns(patterns: DataFrame, path: str) -> None:
    patterns.write.mode("overwrite").parquet(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags given by hand: a CSV of task_id, trial_number, tag, note."""
    schema = "task_id string, trial_number int, tag string, note string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def append_tags(tags: DataFrame, path: str) -> None:
    tags.select("task_id", "trial_number", "tag", "note").write.mode("append").option(
        "header", True
    ).csv(path)


def untagged_failures(runs: DataFrame, tags: DataFrame) -> DataFrame:
    """Failed runs that nobody tagged yet."""
    failed = runs.where(F.lower("final_status").isin(*tx.FAILED_STATUSES))
    return failed.join(
        tags.select("task_id", "trial_number"), ["task_id", "trial_number"], "left_anti"
    )


def read_benchmark_records(spark: SparkSession, path: str, split: str = "train") -> dict[str, DataFrame]:
    """Benchmark records (parquet or JSON lines) as runs, steps, rejected rows and counters."""
    reader = spark.read.schema(schemas.BENCHMARK_RECORD)
    records = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    converted = shaping.convert_records(records, split)
    runs = converted.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return {
        "runs": runs,
        "steps": shaping.record_steps(records),
        "rejected": converted.where(F.col("reject_reason").isNotNull()).select(
            "run_id", "reject_reason"
        ),
        "counters": conversion_counters(converted),
    }


def conversion_counters(converted: DataFrame) -> DataFrame:
    ok = F.col("reject_reason").isNull()
    flag = F.col("likely_root_cause_was_inefficient_planning")
    return converted.agg(
        F.count_if(ok).alias("total_converted"),
        F.count_if(~ok).alias("skipped"),
        F.count_if(ok & F.col("original_subtype_missing")).alias("original_subtype_missing"),
        F.count_if(ok & F.coalesce(flag, F.lit(False))).alias("step_limit_slow_progress"),
        F.count_if(ok & F.coalesce(~flag, F.lit(False))).alias("step_limit_stuck"),
    )


def append_session_log(rows: DataFrame, path: str) -> None:
    """Append log rows as JSON lines, credentials masked first."""
    tt.redact_frame(rows).write.mode("append").json(path)


def stream_session_log(rows: DataFrame, path: str, checkpoint: str):
    """The streaming form of `append_session_log`; returns the started query."""
    return (
        tt.redact_frame(rows)
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
