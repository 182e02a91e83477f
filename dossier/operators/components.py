"""Connected components of an edge list by alternating star contractions, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.cuts import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) for every node of the edges a, b.

    Rounds go on until none changes an edge: about the logarithm of the longest path of them. Self-loops, repeated edges and
    either direction of an edge are alike; an edge with a null end is none.
    """
    edges = cut(edges.filter("a is not null and b is not null").select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        moved = large.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = cut(moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "small-star")
    return nodes.join(links, nodes.node == links.u, "left").select("node", F.coalesce("v", "node").alias("component"))
