"""Prerequisite graphs by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans import stored


def reach(edges: DataFrame, most: int | None = None) -> DataFrame:
    """a, b -> source, target, depth: every pair that is joined by a path, with the edges of the longest one.

    Each round joins the paths known so far with themselves, so paths of n edges take log2(n) rounds. A node that
    reaches itself means a cycle and raises, as does a path of more than ``most`` edges.
    """
    found = stored(edges.select(F.col("a").alias("source"), F.col("b").alias("target")).distinct().withColumn("depth", F.lit(1)), "paths")
    size = found.agg(F.count("*").alias("n"), F.sum("depth").alias("d"), F.count_if(F.col("source") == F.col("target")).alias("loops"), F.max("depth").alias("top")).first()
    while True:
        if size["loops"] or most and (size["top"] or 0) > most:
            raise ValueError("the graph has a cycle" if size["loops"] else f"a path has more than {most} edges")
        left, right = found.select("source", F.col("target").alias("via"), F.col("depth").alias("d1")), found.select(F.col("source").alias("via"), "target", F.col("depth").alias("d2"))
        longer = left.join(right, "via").select("source", "target", (F.col("d1") + F.col("d2")).alias("depth"))
        found = stored(found.unionByName(longer).groupBy("source", "target").agg(F.max("depth").alias("depth")), "paths")
        before, size = size, found.agg(F.count("*").alias("n"), F.sum("depth").alias("d"), F.count_if(F.col("source") == F.col("target")).alias("loops"), F.max("depth").alias("top")).first()
        if (before["n"], before["d"]) == (size["n"], size["d"]):
            return found


def critical(edges: DataFrame) -> DataFrame:
    """For each node: edges on the longest path below it, nodes below it, and depth * 10 + nodes."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    below = reach(edges).groupBy("source").agg(F.max("depth").alias("d"), F.count("*").alias("n"))
    return nodes.join(below, nodes["node"] == below["source"], "left").select("node", F.coalesce("d", F.lit(0)).alias("depth"), F.coalesce("n", F.lit(0)).alias("unlocks")).withColumn("score", F.col("depth") * 10 + F.col("unlocks"))


def neighbours(edges: DataFrame) -> DataFrame:
    """For each node its direct predecessors and successors, sorted; none is an empty list."""
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("before"), F.lit(None).cast(edges.schema["a"].dataType).alias("after")).unionByName(edges.select(F.col("a").alias("node"), F.lit(None).cast(edges.schema["a"].dataType).alias("before"), F.col("b").alias("after")))
    return both.groupBy("node").agg(F.sort_array(F.collect_set("before")).alias("before"), F.sort_array(F.collect_set("after")).alias("after"))


def cycles(edges: DataFrame) -> DataFrame:
    """Every simple cycle once, as the list of its nodes from the smallest on. Only nodes that may lie on one are followed.

    First nodes without predecessor or successor are peeled off, round by round; then paths grow by one edge from their
    smallest node and never visit a node twice. The number of simple cycles, not the table's size, bounds the work.
    """
    left = stored(edges.select("a", "b").distinct(), "edges")
    while True:
        kept = stored(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "edges")
        if kept.count() == left.count():
            break
        left = kept
    found = left.filter("a = b").select(F.array("a").alias("cycle"))
    paths = stored(left.filter("a < b").select(F.array("a", "b").alias("path")), "cycle-paths")
    while not paths.isEmpty():
        grown = stored(paths.withColumn("a", F.element_at("path", -1)).join(left, "a").filter((F.col("b") == F.get("path", F.lit(0))) | ((F.col("b") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("b")))), "cycle-paths")
        found = found.unionByName(grown.filter(F.col("b") == F.get("path", F.lit(0))).select(F.col("path").alias("cycle")))
        paths = grown.filter(F.col("b") != F.get("path", F.lit(0))).select(F.concat("path", F.array("b")).alias("path"))
    return found
