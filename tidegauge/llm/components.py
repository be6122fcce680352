"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.shared import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes in ``edges`` (a, b: one type). No edges: no rows; a = b adds a node.

    Each round takes the least label among a node and its neighbours, then the label of that label; rounds end when no
    label changes. Only one count a round comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = lower.select(F.col("node").alias("over"), F.col("component").alias("beyond"))
        labels = materialise(lower.join(jump, lower["component"] == jump["over"]).select("node", F.least("component", "beyond").alias("component"), "was"), "labels")
        if not labels.where("component != was").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
