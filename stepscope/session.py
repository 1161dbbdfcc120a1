"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. Partition counts are left to the
# session: they depend on the cluster, and AQE coalesces what is too many.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Folds and word rules cost much time per byte: keep small shuffles parallel.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def arrow_limits(spark: SparkSession, most: int = 32 << 20) -> None:
    """Keep Arrow batches small: texts may be long, and a worker holds a batch or two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="stepscope-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which outlives a lost executor."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def keep(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: cut lineage, read by column.

    `options` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/step-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that lies in fewer splits than there are cores.

    For work that is heavy per row, like taking texts apart. Large tables have many
    splits and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
