"""Connected components of a graph given as edges, by smallest neighbours; nothing leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.handover import hand_over


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the smallest node of each node's component, for nodes that have an edge.

    ``edges`` are distinct and cheap to read again. Alternates two star steps
    until only stars are left: every node links its larger neighbours, then its
    smaller ones, to the smallest of all. Each step is one aggregation and one
    join on a node; a hub's neighbours are rows of its own and its minimum is
    aggregated before the shuffle. Rounds grow with the logarithm of the number
    of nodes.
    """
    links = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi")
    while not _stars(links):
        # larger neighbours of every node to the smallest of its neighbourhood
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # then smaller neighbours, the node itself included
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        small = down.select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi")
        small = small.union(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()
        links = hand_over(small, "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _stars(links: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and none that has a smaller one itself."""
    more = links.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if more.limit(1).count():
        return False
    return links.join(links.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count() == 0
