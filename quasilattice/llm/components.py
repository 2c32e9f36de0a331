"""Connected components of edge tables, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(a, b) (longs); root is the component's smallest node.

    A round takes each node's smallest label among its neighbours, then the label of that label. Labels only fall, so rounds
    end, and equal sums mean that nothing changed. Every round is a written table; nothing is collected but the sums."""
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    before = None
    while True:
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now is None or now == before:
            return labels
        before = now
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("root")).select(F.col("a").alias("node"), "root")
        least = written(labels.unionByName(near).groupBy("node").agg(F.min("root").alias("root")), "labels")
        jump = least.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        labels = written(least.join(jump, least["root"] == F.col("n2"), "left").select("node", F.least("root", "r2").alias("root")), "labels")
