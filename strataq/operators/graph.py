"""Connected components by hooking and pointer doubling, so that a chain takes as many rounds as its length has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.tables import discard, written


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the smallest node that can be reached; null ends link nothing.

    Each round a component's label hooks on the smallest label next to it, and all labels go on to their label's label. The minima are
    combined before the shuffle, a round's labels are written, and the tables of the round before are given back.
    """
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").groupBy("component").agg(F.min("near").alias("hook"))
        # a label is a node too: where it hooks, or else where its own label leads
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next")).join(hooked, "component", "left").select("component", F.least("next", F.coalesce("hook", "next")).alias("next"))
        before, labels = labels, written(labels.join(onward, "component").select("node", F.least("component", "next").alias("component"), (F.col("next") < F.col("component")).alias("moved")), "labels")
        moved = labels.where("moved").limit(1).count()
        labels = labels.drop("moved")
        discard(before)
        if not moved:
            return labels
