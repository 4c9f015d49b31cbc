"""Connected components of a link table by label propagation with pointer jumping, in joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialized


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the undirected links (a, b). Every round at least doubles the reach of a chain of labels."""
    both = materialized(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialized(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        lower = labels.join(heard, labels.node == heard.a).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = materialized(lower.join(root, "component").select("node", "was", F.least("component", "root").alias("component")))
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
