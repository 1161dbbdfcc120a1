"""Windows over event time, replay removal, routing and alerts. Batch frames work too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idle_sessions(
    events: DataFrame, key: str = "session_id", ts: str = "ts", gap: str = "30 seconds",
    watermark: str = "10 minutes",
) -> DataFrame:
    """One row per stretch of a session without an idle gap.

    A stream goes through session windows. In a batch, events of one slot as wide as the
    gap belong to one stretch for sure, so they become one row before the shuffle;
    however busy a session is, only its slots are lined up.
    """
    if not events.isStreaming:
        return _stretches(events, key, ts, gap)
    rows = events.withWatermark(ts, watermark)
    return (
        rows.groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )


def _stretches(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))
    slots = events.where(F.col(ts).isNotNull()).groupBy(
        key, F.floor(F.unix_micros(ts) / width).alias("_slot")
    ).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(key).orderBy("_slot")
    quiet = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(line)) >= width
    numbered = slots.withColumn("_fresh", F.coalesce(quiet, F.lit(True)).cast("int")).withColumn(
        "_stretch", F.sum("_fresh").over(line)
    )
    end = F.timestamp_micros(F.unix_micros(F.max("_to")) + width)
    return numbered.groupBy(key, "_stretch").agg(
        F.min("_from").alias("start"), end.alias("end"), F.sum("_n").alias("n_events")
    ).drop("_stretch")


def drop_replayed(
    events: DataFrame, keys: list[str] = ("session_id", "call_id"), ts: str = "ts",
    watermark: str = "1 hour",
) -> DataFrame:
    """Each call id once per session, though clients resend their history."""
    if events.isStreaming:
        return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def live_metrics(
    steps: DataFrame, ts: str = "ts", size: str = "1 hour", slide: str | None = None,
    watermark: str = "10 minutes", by: list[str] = (),
) -> DataFrame:
    """Steps, flags and failures per time window: steps(ts, flagged, failed)."""
    rows = steps.withWatermark(ts, watermark) if steps.isStreaming else steps
    return (
        rows.groupBy(F.window(ts, size, slide or size).alias("w"), *by)
        .agg(
            F.count(F.lit(1)).alias("n_steps"),
            F.count_if("flagged").alias("n_flagged"),
            F.count_if("failed").alias("n_failed"),
        )
        .select(F.col("w.start").alias("window_start"), *by, "n_steps", "n_flagged", "n_failed")
    )


ROUTES = {
    "plan": ["UserPromptSubmit"],
    "block_check": ["PreToolUse"],
    "step_check": ["PostToolUse"],
    "summary": ["Stop", "SessionEnd"],
}


def route_of(event) -> object:
    """Which check an event goes to; null for events that no check wants."""
    route = F.lit(None).cast("string")
    for name, kinds in ROUTES.items():
        route = F.when(event.isin(*kinds), F.lit(name)).otherwise(route)
    return route


def route_events(events: DataFrame, column: str = "hook_event_name") -> dict[str, DataFrame]:
    """The event stream as one branch per check."""
    routed = events.withColumn("route", route_of(F.col(column)))
    return {name: routed.where(F.col("route") == name) for name in ROUTES}


def alerts(checked: DataFrame, key: str = "run_id") -> DataFrame:
    """Flagged steps with what to tell the user."""
    return checked.where("flagged").select(
        key,
        "step_index",
        F.coalesce("category", F.lit("drift")).alias("category"),
        "confidence",
        "warning",
        F.get("suggestions", F.lit(0)).alias("suggestion"),
    )


def send_alerts(checked: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                key: str = "session_id"):
    """Hand the alerts of each micro-batch to a sink function."""
    return (
        alerts(checked, key)
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
