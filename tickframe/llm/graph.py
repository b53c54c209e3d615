"""Connected components by alternating large-star and small-star steps on an edge table.

Each step keeps the number of edges bounded by the input's and is a group-by minimum plus a
join, both of which split a hub with many neighbours: the minimum is combined before the
shuffle, and the join's side of a hub can be divided by adaptive execution. Edges are cut
after every round, so lost executors repeat one round at most, and nothing but two numbers
per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach; itself if none is smaller."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    pairs = cut(pairs)
    seen = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == seen or not now.n:
            break
        seen = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.withColumnRenamed("m", "v")).filter("u != v").distinct())
        release(edges.sparkSession)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged(reached: DataFrame, links: DataFrame) -> DataFrame:
    """``reached`` (node, component) with the components ``ca`` and ``cb`` of each of ``links`` joined."""
    top = components(links.select("ca", "cb").distinct(), "ca", "cb")
    again = reached.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return cut(again.select("node", F.coalesce("top", "component").alias("component")).unionByName(top))
