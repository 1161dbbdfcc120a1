"""Failure patterns mined from judged runs."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.functions import text as tt
from stepscope.operators import ordered, vectors
from stepscope.session import cut, keep

WIDE = 32  # clusters of a term from which on it is kept as arrays
FEW = 500_000  # clusters that are broadcast, at most; about 20 MB
SENTENCE_END = r"[.!?\n]+"
LEAD_IN = r"(?i)^(Step \d+:|Root cause:|The agent|Agent|Because)\s*"
CUT_POINT = r"(?is)^(.*?)\b(?:" + "|".join(tx.CORRECTIVE_PHRASES) + r")\b"
DEFAULT_TRIGGER = (
    "Agent executed invalid plan or failed to update state based on environment feedback."
)


def number_sorted(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """Number rows of a group from 0 by any sortable column.

    The range-partitioned rows are written once, so their partition number is a fact
    that both passes see alike; each task numbers its own range.
    """
    ranged = cut(
        df.repartitionByRange(F.col(group), F.col(order)).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    shifts = (
        ranged.groupBy(group, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_shift",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(group).orderBy("_part").rowsBetween(
                        Window.unboundedPreceding, -1
                    )
                ),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    here = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)) - 1
    return (
        ranged.withColumn("_rn", here)
        .join(shifts, [group, "_part"])
        .withColumn(out, (F.col("_rn") + F.col("_shift")).cast("long"))
        .drop("_rn", "_shift", "_part")
    )


def _assign(threshold: float):
    """Grouped map: place one slice of a category's documents, in order, into clusters.

    Clusters are kept as sum vectors in an inverted index, so a document meets only
    clusters that share a term with it. Terms of many clusters are arrays, which are added
    as a whole; each cluster's sum is added in the order of the document's terms.
    """

    def run(docs: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        index: dict[str, dict[int, float]] = {}
        wide: dict[str, _Wide] = {}
        square = np.zeros(1024)
        size = 0

        def put(term: str, cluster: int, value: float) -> None:
            if term in wide:
                wide[term].put(cluster, value)
                return
            held = index.setdefault(term, {})
            held[cluster] = value
            if len(held) >= WIDE:
                wide[term] = _Wide(index.pop(term))

        for row in clusters.itertuples(index=False):
            total = 0.0
            for term, value in zip(row.terms, row.totals):
                put(term, row.cluster, value)
                total += value * value
            size = max(size, row.cluster + 1)
            if size > len(square):
                square = np.concatenate([square, np.zeros(max(len(square), size))])
            square[row.cluster] = total
        out = []
        for row in docs.sort_values("ordinal").itertuples(index=False):
            if size == len(square):
                square = np.concatenate([square, np.zeros(size)])
            dots = np.zeros(size)
            for term, weight in zip(row.terms, row.weights):
                if term in wide:
                    held = wide[term]
                    dots[held.ids[: held.n]] += weight * held.values[: held.n]
                else:
                    for cluster, value in index.get(term, {}).items():
                        dots[cluster] += weight * value
            met = np.flatnonzero(dots)
            sims = dots[met] / np.sqrt(square[met])
            best, best_sim = -1, -1.0
            # Only those that may round to the greatest value are rounded.
            for i in np.flatnonzero(sims >= sims.max(initial=0.0) - 1e-11):
                sim = round(float(sims[i]), 12)
                if sim > best_sim:
                    best, best_sim = int(met[i]), sim
            if best < 0 or best_sim < threshold:
                best, size = size, size + 1
            for term, weight in zip(row.terms, row.weights):
                old = wide[term].get(best) if term in wide else index.get(term, {}).get(best, 0.0)
                put(term, best, old + weight)
                square[best] += (old + weight) ** 2 - old**2
            out.append((row.category, row.doc_id, row.ordinal, best))
        return pd.DataFrame(out, columns=["category", "doc_id", "ordinal", "cluster"])

    return run


class _Wide:
    """A term's values in many clusters, as arrays."""

    def __init__(self, held: dict[int, float]):
        self.place = {c: i for i, c in enumerate(held)}
        self.n = len(held)
        self.ids = np.array([*held, *[0] * self.n])
        self.values = np.array([*held.values(), *[0.0] * self.n])

    def get(self, cluster: int) -> float:
        at = self.place.get(cluster)
        return 0.0 if at is None else float(self.values[at])

    def put(self, cluster: int, value: float) -> None:
        at = self.place.setdefault(cluster, self.n)
        if at == self.n:
            if at == len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.ids[at] = cluster
            self.n += 1
        self.values[at] = value


def leader_cluster(
    records: DataFrame, threshold: float = 0.35, slice_rows: int = 20_000
) -> DataFrame:
    """Ordered clustering per category: records(category, doc_id, text).

    Each document, in order of doc_id, joins the most similar cluster at or above the
    threshold (the first on ties) or opens one. The result depends on that order, so a
    category is worked off in slices: a task holds one slice of a category and the
    category's cluster sums, never the whole category. Returns (category, doc_id,
    ordinal, cluster).
    """
    records = keep(records.select("category", "doc_id", "text"), "records")  # read three times
    idf = vectors.idf_table(records, group=["category"])
    weights = vectors.tfidf(
        vectors.term_counts(records, ["category", "doc_id"]),
        idf, ["category", "doc_id"], ["category"],
    )
    packed = weights.groupBy("category", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v")  # one document
    )
    numbered = number_sorted(records.select("category", "doc_id"), "category", "doc_id", "ordinal")
    none = F.expr("cast(array() as array<struct<term:string,weight:double>>)")
    docs = cut(
        numbered.join(packed, ["category", "doc_id"], "left").select(
            "category",
            "doc_id",
            "ordinal",
            F.transform(F.coalesce("v", none), lambda x: x["term"]).alias("terms"),
            F.transform(F.coalesce("v", none), lambda x: x["weight"]).alias("weights"),
        )
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"category string, doc_id {kind}, ordinal int, cluster int"
    spark = docs.sparkSession
    sums = spark.createDataFrame([], "category string, cluster int, term string, total double")
    last = docs.agg(F.max("ordinal")).first()[0]
    placed = None
    for number in range(0 if last is None else last // slice_rows + 1):
        part = docs.where(F.floor(F.col("ordinal") / slice_rows) == number)
        state = sums.groupBy("category", "cluster").agg(
            F.collect_list("term").alias("terms"), F.collect_list("total").alias("totals")
        )
        step = cut(
            part.groupBy("category")
            .cogroup(state.groupBy("category"))
            .applyInPandas(_assign(threshold), schema)
        )
        placed = step if placed is None else placed.unionByName(step)
        if number < last // slice_rows:
            fresh = part.join(step.select("category", "doc_id", "cluster"), ["category", "doc_id"]).select(
                "category", "cluster", F.explode(F.arrays_zip("terms", "weights")).alias("p")
            ).select("category", "cluster", F.col("p.terms").alias("term"), F.col("p.weights").alias("total"))
            sums = cut(
                sums.unionByName(fresh)
                .groupBy("category", "cluster", "term")
                .agg(F.sum("total").alias("total"))
            )
    return placed if placed is not None else spark.createDataFrame([], schema)


def sentences(col: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), SENTENCE_END), tt.strip)
    return F.filter(parts, lambda s: s != "")


def is_corrective(sentence: Column, words: list[str] | None = None) -> Column:
    """True when a word of advice is among the sentence's tokens, by one search."""
    words = tx.CORRECTIVE_WORDS if words is None else words
    words = [w for w in words if re.fullmatch("[a-z0-9_]{2,}", w) and w not in tx.STOPWORDS]
    if not words:
        return F.lit(False)
    found = F.lower(sentence).rlike(rf"(?<![a-z0-9_])(?:{'|'.join(words)})(?![a-z0-9_])")
    return F.coalesce(found, F.lit(False))


def cut_sentence(sentence: Column, pattern: str = CUT_POINT) -> Column:
    """struct(before, after, has_split) of a sentence at its first phrase of advice."""
    head = F.regexp_extract(sentence, pattern, 1)
    split = sentence.rlike(pattern)
    before = F.btrim(head, F.lit(" ,;:-"))
    after = F.btrim(F.substr(sentence, F.length(head) + 1), F.lit(" ,;:-"))
    early = F.length(before) < 5
    return F.struct(
        F.when(~split, sentence).when(early, F.lit("")).otherwise(before).alias("before"),
        F.when(~split, F.lit("")).when(early, sentence).otherwise(after).alias("after"),
        split.alias("has_split"),
    )


def _pattern(words: list[str] | None) -> str:
    return CUT_POINT if words is None else r"(?is)^(.*?)\b(?:" + "|".join(words) + r")\b"


def corrective_text(
    members: DataFrame, chosen: DataFrame, words: list[str] | None = None
) -> DataFrame:
    """Trigger text and advice per cluster.

    members(category, cluster, doc_id, text), chosen(category, cluster, medoid). Advice
    is the first sentence with a word of advice, members before the medoid, by doc_id.
    """
    pattern = _pattern(words)

    def advice(text: Column) -> Column:
        said = F.filter(F.split(text, SENTENCE_END), lambda s: is_corrective(s, words))
        return tt.let(
            tt.strip(F.get(said, F.lit(0))),
            lambda hit: F.coalesce(F.nullif(cut_sentence(hit, pattern)["after"], F.lit("")), hit),
        )

    def trigger(text: Column) -> Column:
        clean = tt.strip(F.regexp_replace(F.coalesce(text, F.lit("")), LEAD_IN, ""))
        first = F.coalesce(F.get(sentences(clean), F.lit(0)), clean)
        before = cut_sentence(first, pattern)["before"]
        picked = F.when(is_corrective(first, words) & (before != ""), before).otherwise(first)
        bare = F.rtrim(tt.strip(F.regexp_replace(picked, LEAD_IN, "")), F.lit(".,;:"))
        return F.when(bare == "", F.lit(DEFAULT_TRIGGER)).otherwise(bare)

    # Few clusters are looked up where the texts lie: a join by cluster has a task a cluster.
    chosen = keep(chosen.select("category", "cluster", "medoid"), "chosen")
    joined = members.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, ["category", "cluster"])
    marked = joined.select(
        "category",
        "cluster",
        "doc_id",
        (F.col("doc_id") == F.col("medoid")).alias("is_medoid"),
        advice(F.col("text")).alias("advice"),
        F.when(F.col("doc_id") == F.col("medoid"), trigger(F.col("text"))).alias("trigger"),
    )
    order = F.when(F.col("advice").isNotNull(), F.struct("is_medoid", "doc_id"))
    return marked.groupBy("category", "cluster").agg(
        F.max("trigger").alias("trigger_description"),
        F.coalesce(
            F.rtrim(tt.strip(F.min_by("advice", order)), F.lit(".,;:")), F.lit("")
        ).alias("safe_alternative"),
        F.bool_or(F.col("advice").isNotNull()).alias("has_corrective"),
    )


def snippet_rows(
    steps: DataFrame, roots: DataFrame, around: int = 2, block: int = ordered.BLOCK
) -> DataFrame:
    """Steps around the root step of each run, by position; the start when it is absent.

    roots(run_id, root_cause_step_index)
    """
    at = steps.select(
        F.col("run_id").alias("_run"), F.col("step_index").alias("_step"), F.lit(True).alias("_has")
    )
    placed = (
        roots.select("run_id", "root_cause_step_index")
        .join(
            at,
            (F.col("run_id") == F.col("_run"))
            & (F.col("root_cause_step_index") == F.col("_step")),
            "left",
        )
        .select(
            "run_id",
            F.when(F.col("_has"), F.col("root_cause_step_index")).otherwise(0).alias("_at"),
        )
    )
    # Only the steps wanted are asked for, by (run, step): a long run is never gathered.
    wanted = placed.select(
        "run_id",
        F.explode(
            F.sequence(F.greatest(F.col("_at") - around, F.lit(0)), F.col("_at") + around)
        ).alias("step_index"),
    )
    action = F.coalesce(F.nullif("action_name", F.lit("")), F.lit("none"))
    return steps.join(wanted, ["run_id", "step_index"]).select(
        "run_id",
        "step_index",
        F.substring(F.coalesce("reasoning", F.lit("")), 1, 150).alias("reasoning"),
        F.substring(action, 1, 50).alias("action_name"),
        F.col("args_key").alias("action_args"),
        F.when(F.col("tool_response") != "", F.substring("tool_response", 1, 150)).alias(
            "tool_response"
        ),
    )


def mine_patterns(
    judgments: DataFrame,
    truth: DataFrame,
    steps: DataFrame | None = None,
    threshold: float = 0.35,
    min_size: int = 3,
    words: list[str] | None = None,
) -> DataFrame:
    """Patterns from the judgments that agree with the truth.

    judgments(run_id, root_cause_error_type, root_cause_step_index, justification),
    truth(run_id, true_type).
    """
    agreed = cut(
        judgments.join(truth.select("run_id", "true_type"), "run_id")
        .where(F.col("root_cause_error_type") == F.col("true_type"))
        .select(
            F.col("root_cause_error_type").alias("category"),
            F.col("run_id").alias("doc_id"),
            F.coalesce("justification", F.lit("")).alias("text"),
            "root_cause_step_index",
        )
    )
    placed = leader_cluster(agreed.select("category", "doc_id", "text"), threshold)
    sizes = placed.groupBy("category", "cluster").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") >= min_size)
    members = placed.join(large, ["category", "cluster"], "left_semi").join(
        agreed.select("category", "doc_id", "text"), ["category", "doc_id"]
    )
    # Vectors are those of the whole category, as in the clustering.
    weights = vectors.tfidf(
        vectors.term_counts(agreed, ["category", "doc_id"]),
        vectors.idf_table(agreed, group=["category"]),
        ["category", "doc_id"], ["category"],
    ).drop("category")
    chosen = vectors.medoids(weights, members, ["category", "cluster"], "doc_id")
    texts = corrective_text(members, chosen, words)
    sources = members.groupBy("category", "cluster").agg(
        F.count(F.lit(1)).alias("source_runs")
    )
    numbered = ordered.number_rows(
        chosen.withColumn("_c", F.col("cluster").cast("long")), "category", ["_c"], out="_no"
    ).drop("_c")
    mined = (
        numbered.join(texts, ["category", "cluster"])
        .join(sources, ["category", "cluster"])
        .join(
            agreed.select("category", F.col("doc_id").alias("medoid"), "root_cause_step_index"),
            ["category", "medoid"],
        )
        .select(
            F.format_string("pattern_%s_%03d", "category", F.col("_no") + 1).alias("pattern_id"),
            "category",
            "cluster",
            "trigger_description",
            "safe_alternative",
            "has_corrective",
            "medoid",
            "root_cause_step_index",
            "source_runs",
            F.lit(1.0).alias("confidence"),
        )
    )
    if steps is None:
        return mined
    rows = snippet_rows(
        steps, mined.select(F.col("medoid").alias("run_id"), "root_cause_step_index")
    )
    item = F.struct("step_index", "reasoning", "action_name", "action_args", "tool_response")
    snippets = rows.groupBy(F.col("run_id").alias("medoid")).agg(
        F.array_sort(F.collect_list(item)).alias("example_snippet")  # five steps at most
    )
    return mined.join(snippets, "medoid", "left")


def pattern_sources(placed: DataFrame, mined: DataFrame) -> DataFrame:
    """(pattern_id, run_id): the runs a pattern comes from, as rows."""
    return mined.select("pattern_id", "category", "cluster").join(
        placed.select("category", "cluster", F.col("doc_id").alias("run_id")),
        ["category", "cluster"],
    ).select("pattern_id", "run_id")
