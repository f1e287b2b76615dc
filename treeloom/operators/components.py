"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.lineage import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``); the component is its least node.

    Each round every node takes the least label among itself and its neighbours, and then the label of that label, so long chains
    take a number of rounds that grows with the logarithm of their length. Null ends are left out; no links give no rows.
    """
    both = links.where("a is not null and b is not null")
    both = written(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near")).select(F.col("a").alias("node"), "near")
        lower = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        moved = written(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
