"""Connected components as DataFrames: smallest label of the neighbours, then pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); comp is the smallest node that it is connected with.

    Each round is written to the shared folder; a path of n nodes takes O(log n) rounds. Nothing is collected.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp"))
    labels = cut(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = cut(step, "step")
        to = step.select(F.col("node").alias("n"), F.col("comp").alias("onward"))
        new = cut(step.join(to, step["comp"] == to["n"]).select("node", "old", F.col("onward").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.filter("old <> comp").isEmpty():
            return labels
