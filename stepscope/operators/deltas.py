"""Response chunks put together into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = (
    "id string, model string, created long, choices array<struct<finish_reason:string,"
    "delta:struct<content:string,reasoning_content:string,thought:string,"
    "tool_calls:array<struct<index:int,id:string,type:string,"
    "function:struct<name:string,arguments:string>>>>>>"
)
PART = 65_536


def parse_chunks(lines: DataFrame) -> DataFrame:
    """`data:` lines as deltas; other lines, end marks and bad JSON are dropped.

    lines(session_id, response_id, seq, line)
    """
    line = F.regexp_replace("line", r"^\r+|\r+$", "")
    payload = F.trim(F.substring(line, 6, 1 << 30))
    parsed = lines.where(line.startswith("data:") & (payload != "[DONE]")).withColumn(
        "c", F.from_json(payload, CHUNK)
    )
    first = F.get("c.choices", F.lit(0))
    return parsed.where(F.col("c").isNotNull()).select(
        "session_id", "response_id", "seq",
        F.nullif(F.col("c.id"), F.lit("")).alias("chunk_id"),
        F.nullif(F.col("c.model"), F.lit("")).alias("model"),
        F.nullif(first["finish_reason"], F.lit("")).alias("finish_reason"),
        first["delta"]["content"].alias("content"),
        F.coalesce(
            F.nullif(first["delta"]["reasoning_content"], F.lit("")), first["delta"]["thought"]
        ).alias("reasoning"),
        first["delta"]["tool_calls"].alias("tool_calls"),
    )


def _joined(name: str) -> Column:
    """Text of a group in chunk order; the value is as long as its chunks together."""
    return F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col(name) != "", F.struct("seq", name)))),
            lambda x: x[name],
        ),
        "",
    )


def assemble_deltas(deltas: DataFrame, part: int = PART) -> DataFrame:
    """One message per response from deltas(session_id, response_id, seq, content, ...).

    Chunks are joined in stretches of `part` first, so that the chunk rows of a long
    response are never sorted in one task, and the stretches then in their order. The
    reason to finish is the last one given in the whole response.
    """
    columns = set(deltas.columns)
    optional = {
        "reasoning": F.lit(None).cast("string"),
        "finish_reason": F.lit(None).cast("string"),
    }
    for name, empty in optional.items():
        if name not in columns:
            deltas = deltas.withColumn(name, empty)
    keyed = deltas.withColumn("part", F.floor(F.col("seq") / part))
    said = F.when(F.col("finish_reason").isNotNull(), F.struct("seq", "finish_reason"))
    stretches = keyed.groupBy("session_id", "response_id", "part").agg(
        _joined("content").alias("content"),
        _joined("reasoning").alias("reasoning"),
        F.max(said).alias("said"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        stretches.withColumn("seq", F.col("part"))
        .groupBy("session_id", "response_id")
        .agg(
            _joined("content").alias("content"),
            _joined("reasoning").alias("reasoning_content"),
            F.coalesce(F.max("said")["finish_reason"], F.lit("stop")).alias("finish_reason"),
            F.sum("n").alias("n_chunks"),
        )
    )


def assemble_tool_calls(deltas: DataFrame) -> DataFrame:
    """One row per tool call of a response; name and arguments joined by call index."""
    rows = deltas.select(
        "session_id", "response_id", "seq", F.explode("tool_calls").alias("t")
    ).select(
        "session_id",
        "response_id",
        "seq",
        F.coalesce("t.index", F.lit(0)).alias("call_index"),
        F.nullif(F.col("t.id"), F.lit("")).alias("call_id"),
        F.nullif(F.col("t.type"), F.lit("")).alias("kind"),
        F.col("t.function.name").alias("name"),
        F.col("t.function.arguments").alias("arguments"),
    )

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq")))

    return rows.groupBy("session_id", "response_id", "call_index").agg(
        F.coalesce(
            latest("call_id"), F.concat(F.lit("call_"), F.col("call_index").cast("string"))
        ).alias("call_id"),
        F.coalesce(latest("kind"), F.lit("function")).alias("type"),
        F.coalesce(F.nullif(_joined("name"), F.lit("")), F.lit("tool")).alias("name"),
        _joined("arguments").alias("arguments"),
        F.min("seq").alias("call_seq"),
    )
