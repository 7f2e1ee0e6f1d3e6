"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of ``edges`` (a, b).

    Each round takes the smallest label among neighbours and then that label's own, so paths shorten by halves. The
    smallest label is aggregated before any shuffle, which a node with any number of edges survives. Rounds end when no label
    changes; each one's labels are a table in the shared folder."""
    both = stored(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b"), F.col("a")).where("a <> b")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        upper = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        after = stored(step.join(upper, F.col("to") == F.col("n")).select("node", F.least("to", "l").alias("label"), (F.least("to", "l") != F.col("old")).alias("changed")), "labels")
        drop_stored(labels)
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            drop_stored(both)
            return labels
