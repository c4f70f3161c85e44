"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentguard.llm.shared import discard, stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Each round hangs every node under the smallest node it knows of; the rounds grow with the logarithm of the
    number of nodes. Minima are aggregated before they are joined, so a node with very many links is
    split by the join. Each round is written to the shared folder, and what only it needed is removed.
    """
    edges = stage(_smaller(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        large = stage(_smaller(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "links-large")
        down = stage(large.groupBy("u").agg(F.min("v").alias("m")), "links-down")
        joined = large.join(down, "u")
        small = stage(_smaller(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v")))), "links-small")
        discard(edges, least, large, down)
        if _stars(small):
            break
        edges = small
    roots = small.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _smaller(edges: DataFrame) -> DataFrame:
    return edges.where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node, and no node that has others below hangs itself."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
