"""Row order inside a run, without putting a whole run into one task.

A run may hold a third of all rows, so no window here is partitioned by the run
alone. Rows are numbered in slices, look-back windows work on blocks of
consecutive rows with a small overlap, and running values add a per-block offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
# A run is sliced when it holds more than 1/SHARE of the rows, so there are at
# most SHARE such runs, and at most 2*SHARE slices: a fixed bound for broadcasts.
SHARE = 1000
MIN_SLICE = 100_000


def _as_number(col: Column, kind: str) -> Column:
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(col.cast("timestamp"))
    return col.cast("long")


def number_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    out: str = "step_index",
    min_slice: int = MIN_SLICE,
) -> DataFrame:
    """Number the rows of each run from 0 in `order`.

    `order[0]` must be an integer or a time. The run sizes are looked up first. If no
    run holds more than its share, one window numbers all. Otherwise the large runs,
    of which there are at most SHARE, are cut into equal ranges of `order[0]`; each
    range is numbered alone and then shifted by the rows before it.
    """
    spark = df.sparkSession
    at = _as_number(F.col(order[0]), df.schema[order[0]].dataType.typeName())
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    target = max(min_slice, -(-(total or 0) // SHARE))
    if (largest or 0) <= target:
        alone = Window.partitionBy(key).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(alone) - 1).cast("long"))
    hot = (
        df.groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        .where(F.col("_n") > target)
        .withColumn("_k", F.ceil(F.col("_n") / target))
        .drop("_n")
    )
    hot = F.broadcast(spark.createDataFrame(hot.collect(), hot.schema))  # at most SHARE rows
    width = (F.col("_hi") - F.col("_lo") + 1) / F.col("_k")
    sliced = df.join(hot, df[key] == F.col("_key"), "left").withColumn(
        "_slice", F.coalesce(F.floor((at - F.col("_lo")) / width), F.lit(0))
    )
    counted = (
        sliced.where(F.col("_key").isNotNull())
        .groupBy("_key", "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    before = Window.partitionBy("_skey").orderBy("_sslice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = spark.createDataFrame(counted.collect(), counted.schema).select(  # 2 * SHARE rows
        F.col("_key").alias("_skey"), F.col("_slice").alias("_sslice"), "_rows"
    ).withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    in_slice = Window.partitionBy(key, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(in_slice) - 1)
        .join(
            F.broadcast(shifts),
            (F.col(key) == F.col("_skey")) & (F.col("_slice") == F.col("_sslice")),
            "left",
        )
        .withColumn(out, (F.col("_rn") + F.coalesce(F.col("_shift"), F.lit(0))).cast("long"))
        .drop("_key", "_k", "_lo", "_hi", "_slice", "_rn", "_skey", "_sslice", "_shift")
    )


def in_blocks(
    df: DataFrame, key: str, pos: str, back: int = 0, ahead: int = 0, block: int = BLOCK
) -> DataFrame:
    """Give every row its block, and copy the rows a neighbour block looks at.

    `_own` is false for such copies. `pos` must number the rows of a run without
    gaps. At most `back + ahead` rows per block are copied.
    """
    at = F.col(pos)
    home = F.floor(at / F.lit(block))
    if not back and not ahead:
        # Blocks kept from an earlier operator keep its partitioning as well.
        blocks = df if "_block" in df.columns else df.withColumn("_block", home)
        return blocks.withColumn("_own", F.lit(True))
    df = df.drop("_block")
    if back > block or ahead > block:
        raise ValueError("look-back longer than a block")
    spots = [home]
    if back:
        spots.append(F.when(at % block >= block - back, home + 1))
    if ahead:
        spots.append(F.when((at % block < ahead) & (home > 0), home - 1))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(F.array_compact(F.array(*spots))))
        .withColumn("_own", F.col("_home") == F.col("_block"))
        .drop("_home")
    )


def block_window(key: str, pos: str):
    return Window.partitionBy(key, "_block").orderBy(pos)


def neighbours(
    df: DataFrame,
    key: str,
    pos: str,
    columns: Callable[[object], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    block: int = BLOCK,
    keep: bool = False,
) -> DataFrame:
    """Add columns computed over a window of up to `back`/`ahead` rows.

    With `keep` the block column stays, so that `running` and `join_runs` can
    follow without another shuffle.
    """
    blocks = in_blocks(df, key, pos, back, ahead, block)
    out = blocks.withColumns(columns(block_window(key, pos))).where("_own").drop("_own")
    return out if keep else out.drop("_block")


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


LOOK_UP = object()


def long_runs(steps: DataFrame, key: str, pos: str, block: int = BLOCK) -> DataFrame | None:
    """Runs of more than one block with their last block; None when there are none.

    The longest run is looked up first: tables of ordinary runs need no second pass.
    """
    longest = steps.agg(F.max(pos)).first()[0]
    if longest is None or longest < block:
        return None
    return (
        steps.groupBy(F.col(key).alias("_lk"))
        .agg(F.floor(F.max(pos) / F.lit(block)).alias("_top"))
        .where(F.col("_top") > 0)
    )


def running(
    df: DataFrame,
    key: str,
    pos: str,
    values: dict[str, tuple[str, Column]],
    block: int = BLOCK,
    longs=LOOK_UP,
) -> DataFrame:
    """Running sum / max / min / last non-null per run, up to the current row.

    Windows run inside blocks; what came before a block is one row per block,
    carried over by a second, tiny window. Only runs of several blocks (`longs`)
    take part in that second pass.
    """
    kept = "_block" in df.columns
    base = in_blocks(df, key, pos, block=block).drop("_own")
    base = base.withColumns({f"_v_{name}": col for name, (_, col) in values.items()})
    longs = long_runs(df, key, pos, block) if longs is LOOK_UP else longs

    def agg(kind: str, name: str) -> Column:
        if kind == "last":
            return F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col(pos)))
        return _COMBINE[kind](f"_v_{name}")

    def over(kind: str, col: str, window) -> Column:
        if kind == "last":
            return F.last(col, ignorenulls=True).over(window)
        return _COMBINE[kind](col).over(window)

    upto = block_window(key, pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = base.withColumns({f"_i_{n}": over(k, f"_v_{n}", upto) for n, (k, _) in values.items()})
    if longs is None:
        done = {
            n: F.coalesce(F.col(f"_i_{n}"), F.lit(0)) if k == "sum" else F.col(f"_i_{n}")
            for n, (k, _) in values.items()
        }
        scratch = [f"_{x}_{n}" for n in values for x in "vi"]
        return inside.withColumns(done).drop(*scratch, *([] if kept else ["_block"]))
    before = Window.partitionBy("_bk").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        base.join(longs, F.col(key) == F.col("_lk"), "left_semi")
        .groupBy(F.col(key).alias("_bk"), F.col("_block").alias("_bb"))
        .agg(*[agg(kind, name).alias(f"_t_{name}") for name, (kind, _) in values.items()])
        .withColumns({f"_o_{n}": over(k, f"_t_{n}", before) for n, (k, _) in values.items()})
        .where(F.col("_bb") > 0)
        .drop(*[f"_t_{name}" for name in values])
    )
    joined = inside.join(
        blocks, (F.col(key) == F.col("_bk")) & (F.col("_block") == F.col("_bb")), "left"
    )
    merged = {}
    for name, (kind, _) in values.items():
        here, offset = F.col(f"_i_{name}"), F.col(f"_o_{name}")
        if kind == "sum":
            merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(offset, F.lit(0))
        elif kind == "max":
            merged[name] = F.greatest(here, offset)
        elif kind == "min":
            merged[name] = F.least(here, offset)
        else:
            merged[name] = F.coalesce(here, offset)
    extra = ["_bk", "_bb"] if kept else ["_block", "_bk", "_bb"]
    for name in values:
        extra += [f"_v_{name}", f"_i_{name}", f"_o_{name}"]
    return joined.withColumns(merged).drop(*extra)


def join_runs(
    steps: DataFrame,
    runs: DataFrame,
    key: str = "run_id",
    pos: str = "step_index",
    how: str = "left",
    block: int = BLOCK,
    longs=LOOK_UP,
) -> DataFrame:
    """Join one row per run onto the steps of the run.

    The run's row is repeated once per block, and the join is by (run, block), so
    that a long run is spread over many tasks.
    """
    kept = "_block" in steps.columns
    longs = long_runs(steps, key, pos, block) if longs is LOOK_UP else longs
    wide = runs.withColumnRenamed(key, "_rk")
    zero = F.lit(0).cast("long")
    if longs is None:
        wide = wide.withColumn("_rb", F.explode(F.array(zero)))
    else:
        wide = (
            wide.join(longs, F.col("_rk") == F.col("_lk"), "left")
            .withColumn("_rb", F.explode(F.sequence(zero, F.coalesce("_top", zero))))
            .drop("_lk", "_top")
        )
    joined = (
        in_blocks(steps, key, pos, block=block)
        .drop("_own")
        .join(wide, (F.col(key) == F.col("_rk")) & (F.col("_block") == F.col("_rb")), how)
        .drop("_rk", "_rb")
    )
    return joined if kept else joined.drop("_block")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; pre-aggregates before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )
