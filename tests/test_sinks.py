"""Stored tables and streams that are written again."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stepscope import catalog
from stepscope.sources import runs
from stepscope.streaming import sinks, windows


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.range(400).select(F.col("id").alias("run_id"), F.lit("a").alias("final_status"))
    runs.upsert_table(first, path, buckets=16)
    before = files(path)
    fresh = spark.createDataFrame([(3, "b"), (1000, "b")], "run_id long, final_status string")
    for _ in range(2):  # the second time changes no row
        runs.upsert_table(fresh, path, buckets=16)
        got = {r["run_id"]: r["final_status"] for r in runs.read_table(spark, path).collect()}
        assert got == {i: "a" for i in range(400)} | {3: "b", 1000: "b"}
        assert runs.read_table(spark, path).count() == 401
    kept = before & files(path)
    touched = {f.split("_part=")[1].split("/")[0] for f in before - kept}
    assert len(touched) <= 2 and len(kept) >= 14
    none = fresh.limit(0)
    after = files(path)
    runs.upsert_table(none, path, buckets=16)
    assert files(path) == after


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "rows")
    sink = sinks.batch_sink(path)
    for n, batch in ((3, 0), (4, 1), (4, 1)):
        sink(spark.range(n), batch)
    got = sinks.written(spark, path, spark.range(1).schema)
    assert got.columns == ["id"] and got.count() == 7
    assert sinks.written(spark, path, spark.range(1).schema, "complete").count() == 4


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Sessions, replays and metrics over two drops of files equal those of a batch."""
    source, schema = str(tmp_path / "in"), "session_id long, call_id long, ts timestamp, flagged boolean, failed boolean"
    rows = spark.range(600).selectExpr(
        "id % 7 AS session_id", "id % 200 AS call_id", "timestamp_seconds(1000000 + id * 37) AS ts",
        "id % 3 = 0 AS flagged", "id % 5 = 0 AS failed",
    )
    made = {
        "sessions": (lambda df: windows.idle_sessions(df, gap="10 minutes"), "complete"),
        "replays": (lambda df: windows.drop_replayed(df, watermark="30 days").select("session_id", "call_id"), "append"),
        "metrics": (lambda df: windows.live_metrics(df, size="1 hour"), "complete"),
    }
    got = {}
    for part in ("ts < timestamp_seconds(1011000)", "ts >= timestamp_seconds(1011000)"):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        for name, (build, mode) in made.items():
            got[name] = sinks.drained(build(spark.readStream.schema(schema).parquet(source)), str(tmp_path / name), mode)
    batch = spark.read.schema(schema).parquet(source)
    for name, (build, _) in made.items():
        want = build(batch)
        assert sorted(map(str, got[name].select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_streams_read_tables_that_are_folders(spark, sf, tmp_path):
    """Every table may be a folder of files, as large ones are; an empty stream has no row."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("a10_streamed_log", "h3_streamed_replays"):
        here, there = (catalog.QUERIES[name](spark, d) for d in (str(tmp_path), sf))
        assert here.count() == there.count() > 0
        assert here.exceptAll(there).isEmpty()
    assert sinks.written(spark, f"{tmp_path}/nothing", spark.range(1).schema).count() == 0
