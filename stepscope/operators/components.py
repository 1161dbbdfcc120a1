"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """Label every linked node with the smallest node it can reach: columns node, component.

    Rounds of large-star and small-star steps: a node's larger neighbours, and then its
    smaller ones, are linked to the smallest neighbour instead, until every component is
    one star. No group is gathered: each step is a minimum per node and a join, and the
    number of links never grows. Lineage is cut by a checkpoint in each round. Links
    with a null end and links of a node to itself give no row.
    """
    up: Column = F.greatest(a, b)
    edges = links.where(F.col(a) != F.col(b)).select(up.alias("u"), F.least(a, b).alias("v"))
    edges = cut(edges.distinct())
    known = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(lower, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = cut(star.select("e.*").where("u != v").distinct())
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
