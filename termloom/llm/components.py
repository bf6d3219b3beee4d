"""Connected components of an edge table, every step a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """a, b (longs, either way round) -> node, component: the smallest node that each node is linked to.

    Each round takes the smallest label around every node, then follows it one step (labels are nodes), so
    chains shrink by half; labels are written after each round. Nodes without edges are not in the result.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    held = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        step = written(low.join(jump, "low").select("node", "label", F.least("low", "next").alias("new")), "labels")
        changed = not step.filter("new <> label").isEmpty()
        discard(held)  # the step that read it is written
        labels, held = step.select("node", F.col("new").alias("label")), step
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
