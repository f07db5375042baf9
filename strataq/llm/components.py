"""Connected components of a graph that is only ever held as a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.tables import written


def unsettled(edges: DataFrame) -> bool:
    """Whether any node has two smaller ones, or one that itself has a smaller one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0])


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``links`` (a, b): the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each a grouped minimum and a join, until
    every node hangs on its smallest one. Minima are combined before the shuffle, so a hub is no hot spot.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while unsettled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.unionByName(edges.join(least.withColumnRenamed("m", "mu"), "u").select("u", F.col("mu").alias("v")).where("u != v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
