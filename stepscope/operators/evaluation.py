"""Predicted against true root causes: distributions, accuracy, confusion, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.operators import detectors


def attach_truth(judgments: DataFrame, truth: DataFrame) -> DataFrame:
    """Left join of judgments and truth.

    truth(run_id, true_type, true_step, benchmark, total_steps, n_steps). Runs without
    truth get benchmark `unknown` and a total of 0.
    """
    known = truth.select(
        "run_id",
        "true_type",
        "true_step",
        "benchmark",
        F.coalesce(F.nullif("total_steps", F.lit(0)), "n_steps").alias("total_steps"),
    )
    return judgments.join(known, "run_id", "left").withColumns(
        {
            "benchmark": F.coalesce("benchmark", F.lit("unknown")),
            "total_steps": F.coalesce("total_steps", F.lit(0)),
        }
    )


def category_distribution(records: DataFrame) -> DataFrame:
    """Counts per predicted category, overall and per benchmark, in one pass."""
    category = F.coalesce("root_cause_error_type", F.lit("unknown"))
    return (
        records.select("benchmark", category.alias("category"))
        .groupingSets([["category"], ["benchmark", "category"]], "benchmark", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("benchmark").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "overall").otherwise(F.col("benchmark")).alias("benchmark"),
            "category",
            "n",
        )
    )


def position_bucket(step: Column, total: Column) -> Column:
    ratio = step / total
    return (
        F.when(ratio < 0.33, "early").when(ratio <= 0.66, "mid").otherwise("late")
    )


def position_buckets(records: DataFrame) -> DataFrame:
    """Where in the run the predicted step lies, per category."""
    usable = records.where(
        F.col("root_cause_step_index").isNotNull() & (F.col("total_steps") > 0)
    ).select(
        F.coalesce("root_cause_error_type", F.lit("unknown")).alias("category"),
        position_bucket(F.col("root_cause_step_index"), F.col("total_steps")).alias("bucket"),
    )
    return usable.groupBy("category").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("early", "mid", "late")]
    )


def accuracy_report(records: DataFrame) -> DataFrame:
    """Accuracy per true category and overall, with and without corrupted records."""
    known = records.where(F.col("true_type").isNotNull())
    corrupted = (
        F.coalesce("suspected_corrupted_action", F.lit(False))
        if "suspected_corrupted_action" in records.columns
        else F.lit(False)
    )
    views = F.array_compact(
        F.array(F.lit("including_corrupted"), F.when(~corrupted, F.lit("excluding_corrupted")))
    )
    right = F.coalesce(F.col("root_cause_error_type") == F.col("true_type"), F.lit(False))
    return (
        known.select(F.explode(views).alias("view"), F.col("true_type").alias("category"), right.alias("r"))
        .groupingSets([["view", "category"], ["view"]], "view", "category")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("r").alias("correct"),
            F.round(F.count_if("r") / F.count(F.lit(1)), 4).alias("accuracy"),
        )
        .select("view", F.coalesce("category", F.lit("overall")).alias("category"),
                "total", "correct", "accuracy")
    )


def known_tag(col: Column) -> Column:
    return F.when(col.isin(*tx.TAGS), col).otherwise("other")


def with_hits(records: DataFrame) -> DataFrame:
    """Judged records with truth: `pred`, `right`, step distance flags."""
    gap = F.abs(F.col("root_cause_step_index") - F.col("true_step"))
    pred = known_tag(F.col("root_cause_error_type"))
    return (
        records.where(F.col("true_type").isNotNull())
        .withColumn("pred", pred)
        .withColumn("right", F.col("pred") == F.col("true_type"))
        .withColumn("step_exact", F.coalesce(gap == 0, F.lit(False)))
        .withColumn("step_within1", F.coalesce(gap <= 1, F.lit(False)))
    )


def judge_metrics(records: DataFrame) -> DataFrame:
    """Category and step accuracy over all judged runs; missing steps count as misses."""
    n = F.count(F.lit(1))

    def share(flag: str) -> Column:
        return F.when(n > 0, F.count_if(flag) / n).otherwise(0.0)

    return with_hits(records).agg(
        n.alias("total_evaluated"),
        share("right").alias("category_accuracy"),
        share("step_exact").alias("step_exact_accuracy"),
        share("step_within1").alias("step_within1_accuracy"),
    )


def confusion_matrix(records: DataFrame) -> DataFrame:
    """True tag by predicted tag, every tag listed."""
    cells = with_hits(records).groupBy(F.col("true_type").alias("tag")).agg(
        *[F.count_if(F.col("pred") == tag).alias(tag) for tag in tx.TAGS]
    )
    return (
        tx.tag_table(records.sparkSession)
        .join(cells, "tag", "left")
        .na.fill(0, tx.TAGS)
        .select(F.col("tag").alias("true_tag"), *tx.TAGS)
    )


def per_category_rates(records: DataFrame) -> DataFrame:
    """Match rate of each of the seven tags, 0 where there is no data."""
    rates = with_hits(records).groupBy(F.col("true_type").alias("tag")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct")
    )
    return (
        tx.tag_table(records.sparkSession)
        .join(rates, "tag", "left")
        .select(
            "tag_no",
            "tag",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("correct", F.lit(0)).alias("correct"),
            F.coalesce(F.col("correct") / F.col("total"), F.lit(0.0)).alias("match_rate"),
        )
    )


def disagreements(records: DataFrame) -> DataFrame:
    return with_hits(records).where(~F.col("right")).select(
        "run_id", "benchmark", F.col("true_type").alias("true_category"),
        F.col("pred").alias("pred_category"), "true_step",
        F.col("root_cause_step_index").alias("pred_step"), "justification",
    )


def worst_category(records: DataFrame, examples: int = 5) -> DataFrame:
    """Examples of the category judged worst; the first in tag order on ties."""
    rates = per_category_rates(records).where(F.col("total") > 0)
    worst = rates.agg(F.min_by("tag", F.struct("match_rate", "tag_no")).alias("tag"))
    return (
        disagreements(records)
        .where(F.col("true_category") == worst.scalar())
        .orderBy("run_id")
        .limit(examples)
    )


def holdout_sample(
    runs: DataFrame, n: int = 30, seed: int = 42, tuning: DataFrame | None = None
) -> DataFrame:
    """A repeatable sample of confidently tagged runs, without the tuning runs.

    The order is a hash of run and seed, so it does not depend on partitions.
    """
    pool = runs.where(F.col("tag_confidence") == 1.0)
    if tuning is not None:
        pool = pool.join(tuning.select("run_id"), "run_id", "left_anti")
    rank = F.md5(F.concat(F.col("run_id").cast("string"), F.lit(f":{seed}")))
    return pool.withColumn("_rank", rank).orderBy("_rank", "run_id").limit(n).drop("_rank")


def select_ids(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs of a list, in its order: wanted(pos, run_id). Missing runs keep `found` false."""
    marked = runs.withColumn("found", F.lit(True))
    return wanted.join(marked, "run_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def order_by_payload_length(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    return payloads.withColumn("payload_length", F.length(payload)).orderBy(
        "payload_length", "run_id"
    )


def pending_runs(runs: DataFrame, judged: DataFrame) -> DataFrame:
    return runs.join(judged.select("run_id").where(F.col("run_id").isNotNull()), "run_id", "left_anti")


def propagation_report(records: DataFrame, steps: DataFrame) -> dict[str, DataFrame]:
    """The parts of the propagation report, each a frame."""
    roots = records.where(F.col("root_cause_step_index").isNotNull()).select(
        "run_id", "root_cause_step_index"
    )
    return {
        "category_distribution": category_distribution(records),
        "step_position_distribution": position_buckets(records),
        "accuracy": accuracy_report(records),
        "downstream_effects": detectors.downstream_effects(steps, roots),
        "records_summary": records.select(
            "run_id", "benchmark",
            F.col("root_cause_error_type").alias("predicted_category"),
            F.col("root_cause_step_index").alias("predicted_step"),
            F.col("true_type").alias("gt_category"),
            F.col("true_step").alias("gt_step"),
        ),
    }


def calibrated_thresholds(rates: DataFrame, minimum: int = 5) -> DataFrame:
    """A similarity threshold per tag: the less a judge was right, the higher the bar.

    Without data the bar is 0.50; with few cases or under half right it is 0.40.
    """
    rate, total = F.col("match_rate"), F.col("total")
    return rates.select(
        "tag",
        F.when(total == 0, 0.50)
        .when((total < minimum) | (rate < 0.50), 0.40)
        .when(rate < 0.75, 0.25)
        .otherwise(0.20)
        .alias("threshold"),
    )
