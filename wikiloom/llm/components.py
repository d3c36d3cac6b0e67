"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.plans.shared import drop_shared, shared_table


def _least(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node's neighbours (the larger ones, or the smaller ones and itself) go to its least neighbour."""
    if small:
        own = edges.where("u > v")
        least = shared_table(own.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        joined = own.join(least, "u")
        moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (u, v): the least node that it reaches.

    Each round replaces the links by links to lesser nodes that leave the components as they are (Kiveris and others,
    2014), until all links of a node go to its least one; rounds grow with the logarithm of the size. The tables of
    links stay in the shared folder: only their counts reach the driver.
    """
    now = shared_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-links")
    while True:
        large = shared_table(_least(now, small=False), "star-links")
        new = shared_table(_least(large, small=True), "star-links")
        # Stable when every node has one link, to a node that has none.
        hubs = new.select(F.col("v").alias("u")).distinct()
        stable = new.join(hubs, "u", "left_semi").union(new.groupBy("u").count().where("count > 1").select("u", F.col("u").alias("v"))).isEmpty()
        drop_shared(now)
        drop_shared(large)
        now = new
        if stable:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
