"""Connected components of an edge list, by alternating star contraction.

Large star: every neighbour above a node is tied to the smallest of the node and its neighbours.  Small star: a node's
smaller neighbours and the node itself are tied to the smallest of them.  Both keep the components; alternated,
they end in stars around each component's smallest node, in about log2(n) rounds.  Every round is written to the
shared folder, so lineage stays short.  A node's neighbours are never collected: an aggregate finds the smallest, and
nodes with very many edges meet it where their edges lie (:func:`tidemark.llm.common.spread_join`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread_join, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
    joined = spread_join(both, least, ["a"], "n")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, root): each node that has an edge, and its component's smallest node."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count = now.count()
    while count:
        before, n_before = now, count
        now = stored(_star(stored(_star(before, large=True), "large"), large=False), "small")
        count = now.count()
        # Both hold distinct edges: as many, and none that is new, means that nothing changed.
        if count == n_before and now.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
