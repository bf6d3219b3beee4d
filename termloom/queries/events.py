"""Event analytics on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import analytics as A
from termloom.sources import table

CODES = {"click": "act", "view": "see", "purchase": "buy"}
BOUNDS = [10.0, 25.0, 50.0, 100.0, 200.0]


def events_summary(spark, sf):
    return A.summary(table(spark, sf, "events"), "event_type", "value", 50.0)


def events_dedup_ingest(spark, sf):
    """A replay of half the users' events arrives after the first delivery."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.lit(0).alias("batch"))
    both = ev.unionByName(ev.filter("user_id % 2 = 0").withColumn("batch", F.lit(1)))
    return A.ingest(both, "event_id", [F.col("batch")]).groupBy("event_type").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("duplicates"))


def events_json_topk(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


def events_rate_limit(spark, sf):
    flagged = A.rate_limit(table(spark, sf, "events"), "user_id", "ts", 3600, 1, [F.col("ts"), F.col("event_id")])
    return flagged.filter("rejected").select("event_id", "user_id", "window_start", F.col("place").cast("long").alias("place"))


def events_retention(spark, sf):
    ev = table(spark, sf, "events")
    last = ev.agg(F.max("ts").alias("last"))
    return ev.crossJoin(F.broadcast(last)).filter(F.col("ts") < F.col("last") - F.expr("INTERVAL 14 DAYS")).groupBy("event_type").agg(F.count("*").alias("purged"))


def events_alias_coalesce(spark, sf):
    codes = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    ev = table(spark, sf, "events").select(codes[F.col("event_type")].alias("code"), "event_type", "value")
    return ev.groupBy(F.coalesce("code", F.lit("other")).alias("action"), F.when(F.col("code").isNull(), F.col("event_type")).alias("overflow")).agg(F.count("*").alias("n"))


def events_sessions(spark, sf):
    s = A.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600, [F.col("ts"), F.col("event_id")])
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def events_time_range(spark, sf):
    """Both ends count."""
    return table(spark, sf, "events").filter(F.col("ts").between("2024-01-05", "2024-01-12")).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean_value"))


def histogram_cumulative(spark, sf):
    return A.cumulative_histogram(table(spark, sf, "events"), "event_type", "value", BOUNDS)


def events_status_rates(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy("user_id").agg(F.count_if(F.expr("event_type = 'error'")).alias("errors"), F.round(F.try_divide(F.count_if(F.expr("event_type = 'purchase'")), F.count_if(F.expr("event_type = 'view'"))), 4).alias("rate"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("spent"))


def events_feedback_promotion(spark, sf):
    """Purchases become feedback rows; the id falls back to the event's id, the day makes a key against repeats."""
    ev = table(spark, sf, "events").filter("event_type = 'purchase' and user_id is not null")
    return ev.select(F.coalesce(F.get_json_object("props", "$.feedback_id"), F.col("event_id").cast("string")).alias("feedback_id"), F.concat_ws(":", F.col("user_id").cast("string"), F.lit("buy"), F.date_format("ts", "yyyy-MM-dd")).alias("dedup_key")).groupBy("dedup_key").agg(F.count("*").alias("n"), F.min("feedback_id").alias("first_id"))


QUERIES = {f.__name__: f for f in (events_summary, events_dedup_ingest, events_json_topk, events_rate_limit, events_retention, events_alias_coalesce, events_sessions, events_time_range, histogram_cumulative, events_status_rates, events_feedback_promotion)}

ORACLE_SQL = {
    "events_summary": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS p95, round(sum(coalesce(value, 0)), 4) AS total, round(count(*) FILTER (WHERE value >= 50) / count(*), 4) AS share FROM events GROUP BY 1",
    "events_dedup_ingest": "SELECT event_type, count(*) AS accepted, count(*) FILTER (WHERE user_id % 2 = 0) AS duplicates FROM events GROUP BY 1",
    "events_json_topk": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 10",
    "events_rate_limit": "SELECT event_id, user_id, w AS window_start, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) AS place FROM (SELECT *, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS w FROM events)) WHERE place > 1",
    "events_retention": "SELECT event_type, count(*) AS purged FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1",
    "events_alias_coalesce": "SELECT coalesce(code, 'other') AS action, CASE WHEN code IS NULL THEN event_type END AS overflow, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'click' THEN 'act' WHEN 'view' THEN 'see' WHEN 'purchase' THEN 'buy' END AS code FROM events) GROUP BY 1, 2",
    "events_sessions": "WITH g AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY 1, 2",
    "events_time_range": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 2) AS mean_value FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-12' GROUP BY 1, 2",
    "histogram_cumulative": "SELECT event_type, b.bound, count(*) FILTER (WHERE value <= b.le) AS n FROM events, (VALUES ('10.0', 10), ('25.0', 25), ('50.0', 50), ('100.0', 100), ('200.0', 200), ('+Inf', 'Infinity'::DOUBLE)) AS b(bound, le) GROUP BY 1, 2",
    "events_status_rates": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS rate, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM events GROUP BY 1",
    "events_feedback_promotion": "SELECT user_id || ':buy:' || strftime(ts, '%Y-%m-%d') AS dedup_key, count(*) AS n, min(CAST(event_id AS VARCHAR)) AS first_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL GROUP BY 1",
}
