"""Connected components of links between traces or their classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settle


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``); the component is its smallest node.

    Every node takes the smallest label among its neighbours, then the label of its label, until nothing changes; the
    second step halves the way to the smallest node, so long chains need few rounds.  Minima are combined before they are
    sent, so a node with very many neighbours costs each task one row.  Every round is written to shared scratch.
    """
    edges = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("seen"))
        lower = settle(labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("component")), "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        found = settle(lower.join(jump, F.col("component") == F.col("at"), "left").select(
            "node", "old", F.least("component", "beyond").alias("component")), "labels")
        discard(labels, lower)
        labels = found
        if labels.where("component <> old").isEmpty():
            discard(edges)
            return labels.select("node", "component")
