"""Plan text to subgoals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.functions import text as tt

_MOVES = ["first", "second", "third", "fourth", "fifth", "then", "next", "finally"]
_NONE = "cast(array() as array<string>)"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _strip(col: Column) -> Column:
    """Trim what Python calls white space, with the four separators that Java leaves out.

    Text that neither begins nor ends with it, which is most, is not searched.
    """
    ends = F.concat(F.left(col, F.lit(1)), F.right(col, F.lit(1)))
    trimmed = F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.when(ends.rlike(r"(?U)[\s\x1c-\x1f]"), trimmed).otherwise(col)


def _holds(text: Column, marks: list[str]) -> Column:
    return reduce(or_, [text.contains(m) for m in marks])


def _clean_items(items: Column) -> Column:
    flat = F.transform(items, lambda m: F.regexp_replace(_strip(m), "\n", " "))
    return F.when(F.size(items) >= 2, F.filter(flat, lambda m: m != "")).otherwise(F.expr(_NONE))


def _taken(way: str):
    def build(items: Column) -> Column:
        return F.when(
            F.size(items) >= 2,
            F.struct(
                F.transform(items, lambda s: F.substring(s, 1, 200)).alias("items"),
                F.lit(False).alias("is_fallback"),
                F.lit(way).alias("strategy"),
            ),
        )

    return build


def plan_items(plan: Column) -> Column:
    """struct(items, is_fallback, strategy) of a plan text.

    Numbered items, else bullets, else transition words, else lines of more than
    ten characters; each way needs two items. Otherwise the plan is one subgoal.
    """

    def build(text: Column) -> Column:
        def found(pattern: str, group: int) -> Column:
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

        def where(holds: Column, items: Column) -> Column:
            return F.when(holds, items).otherwise(F.expr(_NONE))

        words, said = found(tx.TRANSITION_ITEM, 1), found(tx.TRANSITION_ITEM, 2)
        moves = F.zip_with(
            words, said, lambda w, d: F.when(_strip(d) != "", F.concat(w, F.lit(" "), d))
        )
        # Four more letters equal i, k and s for a pattern that takes letters in any case.
        low = F.lower(F.translate(text, "\u0130\u0131\u212a\u017f", "iiks"))
        moving = tt.let(low, lambda t: _holds(t, _MOVES))
        lines = F.filter(
            F.transform(F.split(text, _LINE_END), _strip), lambda s: F.length(s) > 10
        )
        ways = [
            ("numbered", _clean_items(where(_holds(text, [".", ":", ")"]), found(tx.NUMBERED_ITEM, 1)))),
            ("bullets", _clean_items(where(_holds(text, ["-", "*"]), found(tx.BULLET_ITEM, 1)))),
            ("transition", _clean_items(where(moving, F.array_compact(moves)))),
            ("lines", lines),
        ]
        one = F.when(text == "", F.lit(tx.EMPTY_PLAN_ITEM)).otherwise(
            F.concat(
                F.lit("Execute task: "), F.regexp_replace(F.substring(text, 1, 200), "\n", " ")
            )
        )
        tries = [tt.let(items, _taken(way)) for way, items in ways]
        return F.coalesce(
            *tries,
            F.struct(
                F.array(one).alias("items"),
                F.lit(True).alias("is_fallback"),
                F.lit("single").alias("strategy"),
            ),
        )

    return tt.let(_strip(F.coalesce(plan, F.lit(""))), build)


def with_subgoals(plans: DataFrame) -> DataFrame:
    """One row per run with arrays `subgoal_ids` and `descriptions`."""
    parsed = plans.withColumn("_p", plan_items(F.col("proposed_plan")))
    return (
        parsed.withColumn("descriptions", F.col("_p.items"))
        .withColumn("is_fallback", F.col("_p.is_fallback"))
        .withColumn("strategy", F.col("_p.strategy"))
        .withColumn("total_subgoals", F.size("descriptions"))
        .withColumn(
            "subgoal_ids",
            F.transform(
                F.sequence(F.lit(1), F.col("total_subgoals")),
                lambda i: F.format_string("subgoal_%03d", i),
            ),
        )
        .drop("_p")
    )


def parse_plans(plans: DataFrame) -> DataFrame:
    """One row per declared subgoal."""
    return with_subgoals(plans).select(
        "run_id",
        F.posexplode(F.arrays_zip("subgoal_ids", "descriptions")).alias("subgoal_no", "s"),
        "is_fallback",
        "strategy",
    ).select(
        "run_id",
        "subgoal_no",
        F.col("s.subgoal_ids").alias("subgoal_id"),
        F.col("s.descriptions").alias("description"),
        "is_fallback",
        "strategy",
    )
