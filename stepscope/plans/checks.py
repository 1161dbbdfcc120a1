"""Plan text against task text: contradictions and left-out requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.functions import text as tt


def contradiction_matches(pairs=None) -> list[Column]:
    """A match per direction of each pair of opposed terms, in order of precedence."""
    return [
        tt.match_struct(
            "planning_error", 0.92, "keyword",
            rule_id="planning_contradiction",
            description=f"Task explicitly requires '{mine}', "
            f"but proposed plan targets '{other}'",
            safe_alternative=f"Revise plan to target '{mine}' "
            "as specified in task requirements",
        )
        for left, _, right, _ in (tx.OPPOSED_TERMS if pairs is None else pairs)
        for mine, other in ((left, right), (right, left))
    ]


def omission_matches(terms=None) -> list[Column]:
    """A match per required term, in order of precedence."""
    return [
        tt.match_struct(
            "planning_error", 0.85, "keyword",
            rule_id="planning_constraint_omission",
            description=f"Task explicitly requires '{name}', "
            "but proposed plan omits it from planned search/actions",
            safe_alternative=f"Include '{name}' in search parameters and filtering steps",
        )
        for name, _ in (tx.REQUIRED_TERMS if terms is None else terms)
    ]


def opposed_flags(text: Column, pairs=None) -> Column:
    """Whether a text holds the terms of each pair: left, right, left, right."""
    found = [F.lower(text).rlike(r) for _, a, _, b in (tx.OPPOSED_TERMS if pairs is None else pairs) for r in (a, b)]
    return F.array(*[F.coalesce(f, F.lit(False)) for f in found])


def required_flags(text: Column, terms=None) -> Column:
    """Whether a text holds each required term."""
    found = [F.lower(text).rlike(r) for _, r in (tx.REQUIRED_TERMS if terms is None else terms)]
    return F.array(*[F.coalesce(f, F.lit(False)) for f in found])


def acts(plan: Column, verbs: str | None = None) -> Column:
    return F.lower(plan).rlike(verbs or tx.ACTING_VERBS)


def plan_contradiction(task: Column, plan: Column, pairs=None) -> Column:
    """A match when the task names one of two opposed terms and the plan the other."""
    task, plan = F.lower(task), F.lower(plan)
    matches, found = iter(contradiction_matches(pairs)), []
    for _, left_re, _, right_re in tx.OPPOSED_TERMS if pairs is None else pairs:
        for mine_re, other_re in ((left_re, right_re), (right_re, left_re)):
            clash = (
                task.rlike(mine_re) & ~task.rlike(other_re)
                & plan.rlike(other_re) & ~plan.rlike(mine_re)
            )
            found.append(F.when(clash, next(matches)))
    return F.coalesce(*found)


def constraint_omission(task: Column, plan: Column, terms=None, verbs: str | None = None) -> Column:
    """A match when an acting plan leaves out a term the task requires."""
    task, plan = F.lower(task), F.lower(plan)
    found = [
        F.when(task.rlike(pattern) & ~plan.rlike(pattern), match)
        for (_, pattern), match in zip(
            tx.REQUIRED_TERMS if terms is None else terms, omission_matches(terms)
        )
    ]
    return F.when(acts(plan, verbs), F.coalesce(*found))


def check_plans(
    plans: DataFrame,
    matches: DataFrame | None = None,
    block_on_critical: bool = False,
    pairs=None,
    terms=None,
    verbs: str | None = None,
    rules=None,
) -> DataFrame:
    """Flags and suggestions per plan; a flagged plan is refused only when blocking.

    `matches(run_id, match)` holds pattern matches of task and plan text, from
    `vectors.nearest_pattern`; a plan without one is tried on the word rules.
    """
    task, plan = F.col("task_description"), F.col("proposed_plan")
    both = "concat_ws(' ', task_description, proposed_plan)"
    base = tt.add_keyword_rule(plans, "_rule", both, rules)
    near = F.col("_rule")
    if matches is not None:
        base = base.join(matches.select("run_id", F.col("match").alias("_near")), "run_id", "left")
        near = F.coalesce("_near", "_rule")
    full = (tt.blank_to_null(task).isNotNull()) & (tt.blank_to_null(plan).isNotNull())
    base = (
        base.withColumn("_c", F.when(full, plan_contradiction(task, plan, pairs)))
        .withColumn("_o", F.when(full, constraint_omission(task, plan, terms, verbs)))
        .withColumn("_m", near)
    )

    def flag(m: Column, rule: bool) -> Column:
        head = F.concat(F.lit("["), m["layer"], *( [F.lit(":"), m["rule_id"]] if rule else []))
        return F.when(
            m["category"] == "planning_error",
            F.concat(
                head,
                F.lit("] planning_error detected (confidence="),
                F.format_string("%.2f", m["confidence"]),
                F.lit("): "),
                m["description"],
            ),
        )

    def advice(m: Column) -> Column:
        return F.when(
            (m["category"] == "planning_error") & (m["safe_alternative"] != ""),
            m["safe_alternative"],
        )

    c, o, m = F.col("_c"), F.col("_o"), F.col("_m")
    flagged = F.size("flags") > 0
    return (
        base.withColumn("flags", F.array_compact(F.array(flag(c, True), flag(o, True), flag(m, False))))
        .withColumn("suggestions", F.array_compact(F.array(advice(c), advice(o), advice(m))))
        .withColumn("flagged", flagged)
        .withColumn("approved", ~(F.col("flagged") & F.lit(block_on_critical)))
        .select(*plans.columns, "approved", "flagged", "flags", "suggestions")
    )
