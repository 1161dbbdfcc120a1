"""What the text operators share: Arrow passes over texts, stored steps, folds, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stepscope.session import checkpoint_folder

ROWS = 1024  # rows of one Arrow batch, and of one call of a text function
BATCH_BYTES = 32 << 20  # a batch of long texts ends earlier


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and a worker holds a batch or two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back.

    This cuts lineage: a lost executor loses no finished step, and a step that two
    branches read is worked out once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def map_texts(
    df: DataFrame,
    work: Callable[[], Callable[[list], dict]],
    fields: list[T.StructField],
    keep: list[str],
    text: str = "text",
    raw: bool = False,
) -> DataFrame:
    """Run a function of lists of texts over a column, in Arrow batches, without a shuffle.

    `work` is called once per task and returns that function, which gets texts (bytes
    if `raw`, None for null) and returns a list or array per field. With a list `_row`
    beside them, of the text each value belongs to, a text may give any number of rows.
    Columns of `keep` pass through; a kept column with the name of a new one gives way.
    """
    arrow_limits(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(schema)
    kind = pa.binary() if raw else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = apply(part.column(len(keep)).cast(kind).to_pylist())
                if "_row" in made:
                    part = part.take(pa.array(made["_row"], pa.int64()))
                arrays = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(made[f.name], arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    return source.mapInArrow(run, schema)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns so that none clashes with an operator's own; old name -> new name."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(names: dict[str, str]) -> list[Column]:
    """The columns put aside, under their old names."""
    return [F.col(new).alias(old) for old, new in names.items()]


def balanced_sample(
    df: DataFrame, group: str, key: str, per_group: int, seed: int = 0
) -> DataFrame:
    """About `per_group` to twice as many rows of each group, chosen by a hash of the key.

    Group sizes are counted first, so that no group is sorted or gathered. `group`
    must have few values; its counts come to the driver.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(1000)
    sizes = {row[group]: row["n"] for row in counts.collect() if row[group] is not None}
    if not sizes:
        return df.where(F.lit(False))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
    share = F.create_map(
        *[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, 1.5 * per_group / n))]
    )
    return df.where(place < share[F.col(group)] * 1_000_000)
