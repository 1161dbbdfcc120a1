"""Run files in and out: single runs, consolidated files, directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepscope import schemas
from stepscope.functions import text as tt
from stepscope.operators import ordered
from stepscope.session import keep


def missing_keys(raw: Column) -> Column:
    """Required keys absent from metadata JSON; a key that holds null is present."""
    keys = F.json_object_keys(raw)
    wanted = F.array(*[F.lit(k) for k in schemas.REQUIRED_KEYS])
    return F.when(keys.isNull(), wanted).otherwise(F.array_except(wanted, keys))


def validate_contract(df: DataFrame, raw: str = "metadata") -> DataFrame:
    """Add `is_valid` (the four keys) and `contract_warning` (the six documented keys)."""
    keys = F.json_object_keys(raw)
    lacking = F.array_except(F.array(*[F.lit(k) for k in schemas.DOCUMENTED_KEYS]), keys)
    return df.withColumn("is_valid", F.size(missing_keys(F.col(raw))) == 0).withColumn(
        "contract_warning",
        F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", "))),
    )


def _reason(meta: Column, item_is_object: Column) -> Column:
    missing = missing_keys(meta)
    return (
        F.when(~item_is_object, "item is not an object")
        .when(meta.isNull(), "item missing 'metadata' key")
        .when(F.json_object_keys(meta).isNull(), "metadata is not an object")
        .when(
            F.size(missing) > 0,
            F.concat(F.lit("missing required keys: "), F.array_join(missing, ", ")),
        )
    )


def _shape(df: DataFrame) -> DataFrame:
    """Raw JSON columns -> the run shape; rows with a reject reason keep it."""
    return df.select(
        "source_path",
        "item_index",
        F.from_json("metadata", schemas.METADATA).alias("metadata"),
        F.from_json("trajectory", schemas.TRAJECTORY).alias("trajectory"),
        "reject_reason",
    )


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).withColumn("path", F.col("_metadata.file_path"))


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    """Files of the form {"runs": [...]}, one row per item, bad items with a reason."""
    items = _files(spark, path).select(
        "path", F.posexplode(F.from_json("value", "runs array<string>")["runs"]).alias("i", "item")
    )
    keys = F.json_object_keys("item")
    meta = F.when(F.array_contains(keys, "metadata"), F.get_json_object("item", "$.metadata"))
    source = F.coalesce(
        F.get_json_object("item", "$.source_path"),
        F.get_json_object("item", "$.source_dir"),
        F.concat(F.lit("index_"), F.col("i").cast("string")),
    )
    return _shape(
        items.select(
            source.alias("source_path"),
            F.col("i").alias("item_index"),
            meta.alias("metadata"),
            F.get_json_object("item", "$.trajectory").alias("trajectory"),
            _reason(meta, keys.isNotNull()).alias("reject_reason"),
        )
    )


def read_run_tree(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files anywhere under a folder, with the trajectory beside them."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    meta = _files(spark, path, "{run_metadata,metadata}.json").select(
        folder.alias("folder"), F.col("path").alias("source_path"), F.col("value").alias("metadata")
    )
    traj = _files(spark, path, "trajectory.json").select(
        folder.alias("folder"), F.col("value").alias("trajectory")
    )
    joined = meta.join(traj, "folder", "left")
    broken = F.col("trajectory").isNotNull() & F.try_parse_json("trajectory").isNull()
    raw = F.col("metadata")
    return _shape(
        joined.select(
            "source_path",
            F.lit(0).alias("item_index"),
            "metadata",
            "trajectory",
            F.when(F.try_parse_json(raw).isNull(), "invalid JSON in metadata")
            .otherwise(
                F.coalesce(
                    _reason(raw, F.lit(True)), F.when(broken, F.lit("invalid JSON in trajectory"))
                )
            )
            .alias("reject_reason"),
        )
    )


def read_single(spark: SparkSession, path: str) -> DataFrame:
    meta = F.get_json_object("value", "$.metadata")
    return _shape(
        _files(spark, path).select(
            F.col("path").alias("source_path"),
            F.lit(0).alias("item_index"),
            meta.alias("metadata"),
            F.get_json_object("value", "$.trajectory").alias("trajectory"),
            _reason(meta, F.lit(True)).alias("reject_reason"),
        )
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of run files, a consolidated file or a single run, told apart by itself.

    Only the kind of the path is looked up on the driver, through the file system the
    path belongs to.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        raise FileNotFoundError(f"dataset path does not exist: {path}")
    if system.getFileStatus(target).isDirectory():
        runs = read_run_tree(spark, path)
        if runs.where(F.col("reject_reason").isNull()).isEmpty():
            raise ValueError(f"no valid run metadata under {path}")
        return runs
    if not path.lower().endswith(".json"):
        raise ValueError(f"unsupported dataset file {path}: expected .json or a folder")
    kind = _files(spark, path).select(
        F.try_parse_json("value").isNotNull().alias("ok"),
        F.json_object_keys("value").alias("keys"),
    ).first()
    if not kind["ok"]:
        raise ValueError(f"invalid JSON in {path}")
    if "runs" in (kind["keys"] or []):
        runs = read_consolidated(spark, path)
    elif "metadata" in (kind["keys"] or []):
        runs = read_single(spark, path)
    else:
        raise ValueError(f"{path} is neither a consolidated dataset nor a single run")
    if runs.where(F.col("reject_reason").isNull()).isEmpty():
        raise ValueError(f"{path} holds no valid run")
    return runs


def valid_runs(read: DataFrame) -> DataFrame:
    """The `runs` table: metadata columns, one row per run."""
    return read.where(F.col("reject_reason").isNull()).select(
        "metadata.*",
        F.col("source_path").alias("meta_path"),
        F.col("trajectory").isNotNull().alias("has_trajectory"),
        F.coalesce(F.size("trajectory.steps"), F.lit(0)).alias("n_listed_steps"),
    ).withColumn("created_at", F.try_to_timestamp("created_at"))


def rejected_runs(read: DataFrame) -> DataFrame:
    return read.where(F.col("reject_reason").isNotNull()).select(
        "source_path", "item_index", "reject_reason"
    )


def run_steps(read: DataFrame) -> DataFrame:
    """The `steps` table; steps without an index take their position."""
    rows = read.where(F.col("reject_reason").isNull()).select(
        F.col("metadata.run_id").alias("run_id"),
        F.posexplode("trajectory.steps").alias("_pos", "s"),
    )
    return rows.select(
        "run_id",
        F.col("_pos").cast("int").alias("step_index"),
        F.col("s.step_index").alias("source_step_index"),
        F.col("s.timestamp").alias("timestamp"),
        F.coalesce("s.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("s.action_name", F.lit("")).alias("action_name"),
        tt.canonical_json(F.col("s.action_args")).alias("args_key"),
        F.col("s.tool_response").alias("tool_response"),
        F.col("s.state_snapshot").alias("state_snapshot"),
        F.col("s.error_tag").alias("error_tag"),
    )


def write_clean_runs(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Runs as a `task_id=/trial_number=` tree of JSON files."""
    runs.write.mode(mode).partitionBy("task_id", "trial_number").json(path)


def write_tables(runs: DataFrame, steps: DataFrame, path: str) -> None:
    """Columnar `runs` and `steps`; steps lie sorted by run, for pruned reads."""
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    (
        steps.repartitionByRange("run_id", "step_index")
        .sortWithinPartitions("run_id", "step_index")
        .write.mode("overwrite")
        .parquet(f"{path}/steps")
    )


def upsert_runs(current: DataFrame, incoming: DataFrame, key: str = "run_id") -> DataFrame:
    """Incoming runs replace those with the same key; new ones are added."""
    kept = current.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming)


def upsert_table(incoming: DataFrame, path: str, key: str = "run_id", buckets: int = 256) -> None:
    """`upsert_runs` into a stored table; only the parts that incoming keys fall into are rewritten.

    The table is Parquet in `buckets` parts by a hash of the key; the number holds for the
    table's whole life. Incoming rows have distinct keys and the table's columns. Doing it
    again changes nothing, so a job that was killed half way is simply started again.
    """
    spark = incoming.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = keep(incoming.withColumn("_part", part), "incoming")
    touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # at most `buckets`
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        current = spark.read.schema(rows.schema).parquet(path).where(F.col("_part").isin(touched))
        rows = keep(upsert_runs(current, rows, key), "merged")  # before its source is replaced
    rows.repartition("_part").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("_part").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that `upsert_table` wrote."""
    return spark.read.parquet(path).drop("_part")


def upsert_sequence(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each run by `order`."""
    return ordered.last_by(versions, [key], [F.col(c) for c in order])
