"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, rest

#: Rounds after which the executors give their heap back: each leaves the garbage of hundreds of short tasks.
REST = 4


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours are linked to the smallest among them and the node itself.  Minima are aggregates; the join that hands them back may meet a hub's whole neighbourhood in one partition, which adaptive execution splits."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """node, label (smallest node reachable) of every node of edges (u, v) that has an edge to another.  Each round is written to the shared folder; the rounds grow with the logarithm of the longest path."""
    edges = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    last = None
    for k in range(most):
        if k % REST == REST - 1:
            rest(edges.sparkSession)
        edges = kept(_star(_star(edges, True), False), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
