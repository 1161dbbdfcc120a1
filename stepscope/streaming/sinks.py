"""Folders that streams write to, safe against replayed micro-batches.

A micro-batch may be handed to its sink again after a failure. Each has a folder of its own
by its id, which is overwritten as a whole, so a replay adds no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the rows of each micro-batch."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def start(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start a stream into `path`; it ends when all that is there has been read.

    Started again with the same checkpoint it goes on where it ended. Mode `append` keeps
    final rows only; `complete` writes the whole result with every micro-batch.
    """
    return (
        rows.writeStream.foreachBatch(batch_sink(path))
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def written(spark: SparkSession, path: str, schema: T.StructType, mode: str = "append") -> DataFrame:
    """What a stream has written: all micro-batches, or the last one of a whole result.

    A stream that found nothing to read has no micro-batch, and no row.
    """
    fields = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        rows = spark.read.schema(fields).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def drained(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read its result back."""
    start(rows, f"{folder}/rows", f"{folder}/state", mode).awaitTermination()
    return written(rows.sparkSession, f"{folder}/rows", rows.schema, mode)
