"""Tool results matched to the calls they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepscope.operators import ordered
from stepscope.session import cut


def _latest_open(left_calls: DataFrame, left_results: DataFrame) -> DataFrame:
    """Result -> most recent open call, as brackets match.

    Calls open and results close; the depth is a running sum that never falls below
    zero. A result closes the call before it on its own depth.
    """
    opened = left_calls.select("session_id", F.col("call_seq").alias("seq"), F.lit(1).alias("move"))
    closed = left_results.select(
        "session_id", F.col("result_seq").alias("seq"), F.lit(-1).alias("move")
    )
    moves = cut(
        ordered.number_rows(opened.unionByName(closed), "session_id", ["seq", "move"], out="pos")
    )
    longs = ordered.long_runs(moves, "session_id", "pos")
    summed = ordered.running(
        moves, "session_id", "pos", {"s": ("sum", F.col("move"))}, longs=longs
    )
    floored = ordered.running(
        summed, "session_id", "pos", {"low": ("min", F.col("s"))}, longs=longs
    )
    low = F.least(F.lit(0), F.col("low"))
    unmatched = (F.col("move") == -1) & (F.col("s") < 0) & (F.col("s") == F.col("low"))
    # A result at a new low found nothing open, unless the low was reached before.
    before = ordered.neighbours(
        floored.withColumn("_floor", low), "session_id", "pos",
        lambda w: {"_before": F.coalesce(F.lag("_floor").over(w), F.lit(0))}, back=1,
    )
    level = F.when(F.col("move") == 1, F.col("s") - low).otherwise(F.col("s") - low + 1)
    leveled = before.where(~(unmatched & (F.col("s") < F.col("_before")))).select(
        F.struct("session_id", level.alias("level")).alias("lane"), "seq", "move"
    )
    lanes = ordered.number_rows(
        cut(leveled.withColumn("lane", F.to_json("lane"))), "lane", ["seq", "move"], out="pos"
    )
    paired = ordered.neighbours(
        lanes, "lane", "pos",
        lambda w: {
            "call_seq": F.when(F.lag("move").over(w) == 1, F.lag("seq").over(w)),
        },
        back=1,
    )
    session = F.get_json_object("lane", "$.session_id")
    kind = left_calls.schema["session_id"].dataType
    return paired.where((F.col("move") == -1) & F.col("call_seq").isNotNull()).select(
        session.cast(kind).alias("session_id"), F.col("seq").alias("result_seq"), "call_seq"
    )


def _keyed(results: DataFrame) -> DataFrame:
    """Results with the tool's name where the call id is missing."""
    return results.withColumn(
        "call_id", F.coalesce(F.nullif("call_id", F.lit("")), F.nullif("name", F.lit("")))
    )


def rejected_results(results: DataFrame) -> DataFrame:
    """Results with neither a call id nor a tool name: nothing says what they answer."""
    return _keyed(results).where(F.col("call_id").isNull())


def pair_tool_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Steps from tool calls and tool results.

    calls(session_id, call_seq, call_id, name, args, reasoning), results(session_id,
    result_seq, call_id, name, content). Each call id counts once; a result without one
    goes by its tool's name, and one without either is in `rejected_results`. A result
    takes the last call of its id made before it; one without such a call takes the most recent
    call that no id claims; otherwise the action is the result's own name or `tool`.
    """
    once = ordered.first_by(
        _keyed(results).where(F.col("call_id").isNotNull()),
        ["session_id", "call_id"], [F.col("result_seq")],
    )
    named = calls.where(F.coalesce("call_id", F.lit("")) != "")
    latest = (
        once.select("session_id", "call_id", "result_seq")
        .join(named.drop("reasoning", "args", "name"), ["session_id", "call_id"])
        .where(F.col("call_seq") < F.col("result_seq"))
        .groupBy("session_id", "call_id", "result_seq")
        .agg(F.max("call_seq").alias("call_seq"))
    )
    claimed = latest.select("session_id", "call_id")
    orphans = once.join(claimed, ["session_id", "call_id"], "left_anti")
    # A later call of an id replaces the earlier one, so each id is open once at most.
    open_calls = ordered.last_by(
        named.join(claimed, ["session_id", "call_id"], "left_anti"),
        ["session_id", "call_id"], [F.col("call_seq")],
    )
    nameless = calls.where(F.coalesce("call_id", F.lit("")) == "")
    rescued = _latest_open(open_calls.unionByName(nameless), orphans)
    links = latest.select("session_id", "result_seq", "call_seq", F.lit("id").alias("paired_by")).unionByName(
        rescued.select("session_id", "result_seq", "call_seq", F.lit("recent").alias("paired_by"))
    )
    body = calls.select(
        "session_id", "call_seq", F.col("name").alias("_name"), "args", "reasoning"
    )
    joined = cut(
        once.join(links, ["session_id", "result_seq"], "left").join(
            body, ["session_id", "call_seq"], "left"
        )
    )
    numbered = ordered.number_rows(joined, "session_id", ["result_seq"])
    return numbered.select(
        F.col("session_id"),
        "step_index",
        "result_seq",
        "call_id",
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("_name", F.nullif("name", F.lit("")), F.lit("tool")).alias("action_name"),
        F.coalesce("args", F.lit("{}")).alias("args_key"),
        F.coalesce("content", F.lit("")).alias("tool_response"),
        F.coalesce("paired_by", F.lit("none")).alias("paired_by"),
    )
