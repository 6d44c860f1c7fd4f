"""Connected components of a table of links by alternating star contraction.

Each round points every node at the smallest node it can see, first through its larger neighbours and
then through its smaller ones. Groups are only ever reduced to their minimum and joined back to their
own rows, so a node with many links costs a partial aggregate and a join that adaptive execution can
split. Rounds grow with the logarithm of a component, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import drop, keep


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("high", "low").union(edges.select("low", "high")).toDF("node", "near")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root"))
    return (both.where("near > node").join(least, "node")
            .select(F.col("near").alias("high"), F.col("root").alias("low")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("root"))
    moved = (edges.join(least, "high").where("low != root")
             .select(F.col("low").alias("high"), F.col("root").alias("low")))
    return least.toDF("high", "low").union(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has two long columns. Returns ``node``, ``root`` (the smallest node of its component)
    for every node that has a link to another one; roots themselves are left out."""
    a, b = links.columns
    edges = keep(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    before = _state(edges)
    while before[0]:
        nearer = keep(_small_star(_large_star(edges)))
        drop(edges)
        edges, after = nearer, _state(nearer)
        if after == before:
            break
        before = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
