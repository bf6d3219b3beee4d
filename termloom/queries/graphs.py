"""Prerequisite graphs on parts (part i opens 2i and 2i + 1), and streams over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import streaming
from termloom.operators import graph as G
from termloom.plans import work_dir
from termloom.sources import table


def _edges(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("b"))
    return parts.filter("b >= 2").select(F.floor(F.col("b") / 2).alias("a"), "b")


def graph_closure(spark, sf):
    return G.reach(_edges(spark, sf)).groupBy("source").agg(F.count("*").alias("unlocks"), F.max("depth").alias("depth"))


def graph_critical_path(spark, sf):
    return G.critical(_edges(spark, sf))


def graph_eligible(spark, sf):
    """Not passed, and every direct prerequisite passed; a part with more A than R lines is passed."""
    passed = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg((F.count_if(F.col("l_returnflag") == "A") > F.count_if(F.col("l_returnflag") == "R")).alias("good")).filter("good").select("p")
    edges = _edges(spark, sf)
    missing = edges.join(passed, F.col("a") == F.col("p"), "left_anti").select(F.col("b").alias("p"))
    all_parts = table(spark, sf, "part").select(F.col("p_partkey").alias("p"))
    return all_parts.join(passed, "p", "left_anti").join(missing, "p", "left_anti").select(F.col("p").alias("p_partkey"))


def graph_info(spark, sf):
    """One row a part: its direct prerequisites and what it opens directly, as text, with its critical-path score."""
    edges = _edges(spark, sf)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return G.neighbours(edges).join(G.critical(edges), "node").select("node", text("before").alias("prerequisites"), text("after").alias("unlocks_directly"), "depth", "unlocks", "score")


def graph_cycles(spark, sf):
    """Part p leads to p + 1, in every second run of five parts the last leads back to the first."""
    p = F.col("p_partkey")
    edges = table(spark, sf, "part").select(p.alias("a"), F.when(p % 10 == 4, p - 4).otherwise(p + 1).alias("b")).filter("a % 5 <> 4 or a % 10 = 4")
    return G.cycles(edges).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"), F.size("cycle").alias("n"))


def stream_dedup(spark, sf):
    ev = streaming.stream_of(spark, f"{sf}/events.parquet", "events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = work_dir(spark, "stream-dedup")
    return streaming.drained(streaming.deduplicated(ev, "event_id", "ts", "40 days"), path).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_window(spark, sf):
    """Events an hour and kind, counted as a stream; equal to the batch count."""
    ev = streaming.stream_of(spark, f"{sf}/events.parquet", "events.parquet").select("event_type", "ts", F.lit(None).cast("timestamp").alias("arrived"))
    counts = streaming.windowed_counts(streaming.event_time(ev, "ts", "arrived", "at"), "at", "event_type", "1 hour", "40 days")
    return streaming.updated(counts, work_dir(spark, "stream-window"), ["window", "event_type"]).select(F.col("window.start").alias("hour"), "event_type", "n")


QUERIES = {f.__name__: f for f in (graph_closure, graph_critical_path, graph_eligible, graph_info, graph_cycles, stream_dedup, stream_window)}

_REACH = "WITH RECURSIVE e AS (SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey >= 2), r(source, target, depth) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.source, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.target)"
_CRITICAL = "n AS (SELECT a AS node FROM e UNION SELECT b FROM e), x AS (SELECT source, count(*) AS u, max(depth) AS d FROM r GROUP BY 1), c AS (SELECT node, coalesce(d, 0) AS depth, coalesce(u, 0) AS unlocks, coalesce(d, 0) * 10 + coalesce(u, 0) AS score FROM n LEFT JOIN x ON source = node)"
ORACLE_SQL = {
    "graph_closure": f"{_REACH} SELECT source, count(*) AS unlocks, max(depth) AS depth FROM r GROUP BY 1",
    "graph_critical_path": f"{_REACH}, {_CRITICAL} SELECT * FROM c",
    "graph_eligible": "WITH p AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') > count(*) FILTER (WHERE l_returnflag = 'R')) SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT k FROM p) AND (p_partkey < 2 OR p_partkey // 2 IN (SELECT k FROM p))",
    "graph_info": f"{_REACH}, {_CRITICAL}, p AS (SELECT b AS node, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS prerequisites FROM e GROUP BY 1), s AS (SELECT a AS node, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS unlocks_directly FROM e GROUP BY 1) SELECT node, coalesce(prerequisites, '') AS prerequisites, coalesce(unlocks_directly, '') AS unlocks_directly, depth, unlocks, score FROM c LEFT JOIN p USING (node) LEFT JOIN s USING (node)",
    "graph_cycles": "WITH RECURSIVE e AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 10 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END AS b FROM part WHERE p_partkey % 5 <> 4 OR p_partkey % 10 = 4), w(path, b) AS (SELECT [a], b FROM e UNION ALL SELECT list_append(path, w.b), e.b FROM w JOIN e ON e.a = w.b WHERE w.b > path[1] AND NOT list_contains(path, w.b)) SELECT array_to_string(path, ',') AS cycle, len(path) AS n FROM w WHERE b = path[1]",
    "stream_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_window": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
}
