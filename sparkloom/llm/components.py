"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step sends a node's neighbours to a smaller neighbour and is one grouping with a minimum and a join back, so that
a node with very many links is never gathered in one task. Edges are checkpointed after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that ``edges`` (u, v) name; root is the smallest node of the component."""
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # Large star: each larger neighbour of u links to the smallest of u and its neighbours.
        pairs = _both_ways(edges)
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            pairs.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: each smaller neighbour of u, and u itself, link to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a")), F.struct(F.col("u").alias("a")))).alias("x"), "m")
            .select(F.col("x.a").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = checkpointed(small)
        # Done once each node has one link and no root has a link of its own.
        if after.count() == edges.count() and not edges.exceptAll(after).take(1):
            edges = after
            break
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
