import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepscope.catalog import inputs
from stepscope.config import Settings
from stepscope.operators import detectors, ordered


@pytest.fixture(scope="module")
def events(spark, sf):
    # One run holds a third of all rows.
    base = spark.read.parquet(f"{sf}/events.parquet")
    return base.withColumn("run_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") + 1))


def test_numbering_slices_hot_runs(events):
    got = ordered.number_rows(events, "run_id", ["ts", "event_id"], min_slice=5)
    want = events.select(
        "event_id",
        (F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")) - 1).alias("w"),
    )
    assert got.join(want, "event_id").where("step_index <> w").count() == 0
    assert got.count() == events.count()


def test_blocks_equal_whole_windows(events):
    rows = ordered.number_rows(events, "run_id", ["ts", "event_id"]).cache()
    whole = Window.partitionBy("run_id").orderBy("step_index")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "error", F.col("event_id"))
    run = ordered.running(
        rows, "run_id", "step_index",
        {"s": ("sum", F.lit(1)), "m": ("max", F.col("value")), "l": ("last", mark)}, block=7,
    )
    near = ordered.neighbours(
        rows, "run_id", "step_index",
        lambda w: {"p": F.lag("event_id", 3).over(w), "q": F.lead("event_id").over(w)},
        back=3, ahead=1, block=7,
    ).select("event_id", "p", "q")
    want = rows.select(
        "event_id", F.sum(F.lit(1)).over(upto).alias("s2"), F.max("value").over(upto).alias("m2"),
        F.last(mark, ignorenulls=True).over(upto).alias("l2"),
        F.lag("event_id", 3).over(whole).alias("p2"), F.lead("event_id").over(whole).alias("q2"),
    )
    both = run.join(near, "event_id").join(want, "event_id")
    assert both.count() == rows.count()
    assert both.where("not (s <=> s2 and m <=> m2 and l <=> l2 and p <=> p2 and q <=> q2)").count() == 0


def test_small_blocks_and_partitions_do_not_change_verdicts(spark, sf):
    steps, plans = inputs.stored_steps(spark, sf), inputs.plans(spark, sf)

    def rows(frame, **options):
        checked = detectors.check_steps(
            frame, plans, Settings(max_subgoal_steps=3), keys=["action_name"], phrase="error",
            use_task=False, **options,
        )
        return sorted(
            (r.run_id, r.step_index, r.warning) for r in
            checked.select("run_id", "step_index", "warning").collect()
        )

    assert rows(steps) == rows(steps.repartition(17), block=6) != []
