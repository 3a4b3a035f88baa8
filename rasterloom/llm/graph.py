"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.runtime import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns ``a, b``); root is the smallest node reachable.

    Each round hangs the larger neighbours of every node under the smallest one, then does the same with the smaller
    neighbours; both steps are a partial aggregate and a join, so a node with very many neighbours is never gathered.
    Rounds are as many as the logarithm of the longest chain. Nulls and self-links are dropped; no edges: no rows.
    """
    edges = checkpoint(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now every edge runs from a node to a smaller one
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(hung.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
