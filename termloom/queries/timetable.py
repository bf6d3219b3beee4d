"""Slots, clashes and intervals on times derived from events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.functions import slots as S
from termloom.operators import intervals as I
from termloom.operators import planning
from termloom.sources import table


def _meetings(spark, sf, *more):
    """Each event is a meeting on its weekday, from its time of day, 20 to 169 minutes long."""
    ev = table(spark, sf, "events").filter("user_id is not null")
    start = F.hour("ts") * 60 + F.minute("ts")
    return ev.select("event_id", "user_id", F.weekday("ts").alias("day"), start.alias("start"), (start + 20 + F.col("event_id") % 150).cast("long").alias("end"), *more)


MEETINGS = "m AS (SELECT event_id, user_id, (isodow(ts) - 1)::INT AS day, hour(ts) * 60 + minute(ts) AS s, hour(ts) * 60 + minute(ts) + 20 + event_id % 150 AS e FROM events WHERE user_id IS NOT NULL), c AS (SELECT *, greatest(s, 480) AS a, least(e, 1260) AS b FROM m), k AS (SELECT *, CASE WHEN a < b THEN (1::BIGINT << CAST(ceil((b - 480) / 30.0) AS INT)) - (1::BIGINT << CAST(floor((a - 480) / 30.0) AS INT)) ELSE 0 END AS mask FROM c)"


def slot_mask(spark, sf):
    m = _meetings(spark, sf).withColumn("mask", S.slot_mask(F.col("start"), F.col("end")))
    return m.select("event_id", "day", "mask", S.mask_text(F.col("mask")).alias("text"))


def slot_week(spark, sf):
    m = _meetings(spark, sf).withColumn("mask", S.slot_mask(F.col("start"), F.col("end")))
    return I.masks(m, ["user_id", "day"]).select("user_id", "day", "mask", F.bit_count("mask").cast("long").alias("busy"))


def slot_clash(spark, sf):
    """Meetings of one user, one calendar day, that touch a common slot."""
    m = _meetings(spark, sf, F.to_date("ts").alias("date")).withColumn("mask", S.slot_mask(F.col("start"), F.col("end")))
    return I.clashes(m, ["user_id", "date"], "event_id").select("user_id", "date", "a", "b", "both")


def slot_overlap_islands(spark, sf):
    m = _meetings(spark, sf).withColumn("mask", S.slot_mask(F.col("start"), F.col("end")))
    week = I.masks(m, ["user_id", "day"]).filter("mask <> 0")
    runs = I.islands(week, ["user_id", "day"], "mask", S.SLOTS)
    return runs.select("user_id", "day", S.hhmm(F.col("first") * 30 + S.OPENS).alias("begin"), S.hhmm(F.col("after") * 30 + S.OPENS).alias("end"))


def slot_profile(spark, sf):
    """Per user and day: slots, longest run and largest gap in hours; then the soft warnings of the week."""
    m = _meetings(spark, sf).withColumn("mask", S.slot_mask(F.col("start"), F.col("end")))
    runs = I.islands(I.masks(m, ["user_id", "day"]).filter("mask <> 0"), ["user_id", "day"], "mask", S.SLOTS)
    gap = F.col("first") - F.lag("after").over(Window.partitionBy("user_id", "day").orderBy("first"))
    days = runs.withColumn("gap", gap).groupBy("user_id", "day").agg(F.max(F.col("after") - F.col("first")).alias("run"), F.max(F.coalesce("gap", F.lit(0))).alias("gap"), F.min("first").alias("first"))
    return days.groupBy("user_id").agg((F.max("run") * 0.5).cast("double").alias("longest_hours"), (F.max("gap") * 0.5).cast("double").alias("gap_hours"), F.count("*").alias("days"), (F.max("run") * 0.5 > 6.0).alias("w1"), (F.max("gap") * 0.5 > 4.0).alias("w2"), F.bool_or(F.col("first") < 2).alias("w3"), (F.count("*") >= 6).alias("w5"))


def interval_overlap_exact(spark, sf):
    """Orders of one customer and priority whose 30 days meet."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.to_date("o_orderdate").alias("from_day"), F.date_add(F.to_date("o_orderdate"), 30).alias("to_day"))
    return I.overlaps(o, ["o_custkey", "o_orderpriority"], "o_orderkey", "from_day", "to_day").select("a", "b", F.col("from").alias("from_day"), F.col("to").alias("to_day"))


def exam_semi_clash(spark, sf):
    """Orders that clash with some other one (exists)."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return I.near_another(o, ["o_custkey"], ["o_orderkey"], "d", 10).groupBy("o_custkey").agg(F.count("*").alias("n"))


def lane_assign(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("from_day"), F.date_add(F.to_date("o_orderdate"), 60).alias("to_day"))
    g = I.lanes_groups(o, ["o_custkey"], "from_day", "to_day", ["o_orderkey"])
    return g.groupBy("o_custkey", "lane_group").agg(F.count("*").alias("n"), F.min("from_day").alias("from_day"), F.max("to_day").alias("to_day"))


def lane_numbers(spark, sf):
    """A lane for each order of 60 days among those of its customer that overlap it."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 60).alias("e"))
    return I.lanes(I.lanes_groups(o, ["o_custkey"], "s", "e", ["o_orderkey"]), ["o_custkey", "lane_group"], "s", "e", ["o_orderkey"]).select("o_orderkey", "lane", "n_lanes")


def rush_moves(spark, sf):
    """The next event of a user within a quarter of an hour, of another kind."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.lead(F.struct("ts", "event_type", "event_id")).over(w).alias("next"))
    gap = (F.unix_timestamp("next.ts") - F.unix_timestamp("ts")) / 60
    return ev.filter(gap.between(0, 900) & (F.col("event_type") != F.col("next.event_type"))).select("event_id", F.col("next.event_id").alias("next_id"), F.floor(gap).alias("gap_minutes"))


def time_format(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn("m", (F.col("o_orderkey") % 1440))
    back = S.to_minutes(S.hhmm(F.col("m")))
    return o.select("o_orderkey", S.hhmm(F.col("m")).alias("clock"), back.cast("long").alias("minutes"), F.weekday("d").alias("weekday"), S.first_weekday(F.col("d"), F.lit(2)).alias("first_wednesday"), S.months_between_calendar(F.col("d"), F.lit("1998-12-01").cast("date")).alias("months_old"), (F.year("d") + 543).alias("be_year"), F.concat(F.date_format("d", "yyyyMMdd"), F.lit("T"), F.replace(S.hhmm(F.col("m")), F.lit(":"), F.lit("")), F.lit("00")).alias("stamp"))


def calendar_rows(spark, sf):
    """Four weekly occurrences of each order."""
    o = table(spark, sf, "orders").select("o_orderkey", S.first_weekday(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")).alias("first"))
    return o.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("week"), "first").select("o_orderkey", "week", F.date_add("first", F.col("week") * 7).alias("day"))


def greedy_plan(spark, sf):
    """Per customer: lines by discount, within 60 pieces and without a clash of slots."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pool = lines.select("o_custkey", (-F.col("l_discount")).alias("rank"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.pow(F.lit(2.0), F.col("l_partkey") % 26).cast("long").alias("mask"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"))
    return planning.greedy(pool, "o_custkey", ["rank", "l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", "mask", "item", 60.0)


def alternatives_fitting(spark, sf):
    """For each line of an order another supplier of its part whose hours meet none of the order's other parts."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    start = F.col("l_suppkey") % 24 * S.SLOT + S.OPENS
    lines = lines.withColumn("mask", S.slot_mask(start, start + 60 + F.col("l_partkey") % 3 * S.SLOT))
    pool = lines.select("l_partkey", "l_suppkey", "mask", (F.col("l_suppkey") % 10 == 0).alias("full")).distinct()
    return I.fitting_alternatives(lines, pool, "l_orderkey", "l_partkey", "l_suppkey")


def plan_repairs(spark, sf):
    """Orders as plans, parts as courses, their suppliers as sections: changes of one line that leave no fault."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    slot = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    first = F.col("l_suppkey") % 48
    hours = F.transform(F.sequence(first, first + F.col("l_partkey") % 3), lambda at: slot("C1", at))
    slots = F.concat(hours, F.array(slot("C2", (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 60)))
    section = (F.concat_ws("-", "l_partkey", "l_suppkey").alias("section"), F.col("l_partkey").alias("course"), slots.alias("slots"), (F.col("l_suppkey") % 10 == 0).alias("full"))
    # three numbers a line move, dealt as repairs() needs them; what they say is worked out behind that
    own = lines.repartition("l_orderkey").distinct().select("l_orderkey", *section, (F.col("l_partkey") % 50 == 0).alias("passed"))
    return planning.repairs(own, lines.select("l_partkey", "l_suppkey").repartition("l_partkey").distinct().select(*section), "l_orderkey")


QUERIES = {f.__name__: f for f in (plan_repairs, alternatives_fitting, slot_mask, slot_week, slot_clash, slot_overlap_islands, slot_profile, interval_overlap_exact, exam_semi_clash, lane_assign, lane_numbers, rush_moves, time_format, calendar_rows, greedy_plan)}

_RUNS = MEETINGS + ", w AS (SELECT user_id, day, bit_or(mask) AS mask FROM k GROUP BY 1, 2), b AS (SELECT user_id, day, i AS slot FROM w, range(26) t(i) WHERE (mask >> i) & 1 = 1), r AS (SELECT user_id, day, min(slot) AS f, max(slot) + 1 AS a FROM (SELECT *, slot - row_number() OVER (PARTITION BY user_id, day ORDER BY slot) AS g FROM b) GROUP BY user_id, day, g)"
ORACLE_SQL = {
    "plan_repairs": "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey AS c, l_suppkey AS s, l_suppkey % 48 AS a, l_suppkey % 48 + l_partkey % 3 AS b, (l_partkey * 7 + l_suppkey) % 60 AS e FROM lineitem), k AS (SELECT y.l_orderkey, y.c, y.s, z.c AS zc, z.s AS zs, y.a <= z.b AND z.a <= y.b AS c1, y.e = z.e AS c2 FROM x y JOIN x z ON z.l_orderkey = y.l_orderkey AND (z.c, z.s) <> (y.c, y.s)), q AS (SELECT l_orderkey, count(*) FILTER (WHERE c1 OR c2) / 2 AS pairs FROM k GROUP BY 1), o AS (SELECT l_orderkey, count(*) FILTER (WHERE s % 10 = 0) AS n_full FROM x GROUP BY 1 HAVING count(*) = count(DISTINCT c) AND count(*) FILTER (WHERE c % 50 = 0) = 0), m AS (SELECT l_orderkey, c, s, count(*) FILTER (WHERE c1 OR c2) AS mine, bool_or(c1) AS c1, bool_or(c2) AS c2 FROM k GROUP BY 1, 2, 3), bad AS (SELECT x.l_orderkey, x.c, x.s, concat_ws(',', CASE WHEN c1 THEN 'C1' END, CASE WHEN c2 THEN 'C2' END, CASE WHEN x.s % 10 = 0 THEN 'C6' END) AS faults FROM x JOIN o ON o.l_orderkey = x.l_orderkey LEFT JOIN q ON q.l_orderkey = x.l_orderkey LEFT JOIN m ON m.l_orderkey = x.l_orderkey AND m.c = x.c AND m.s = x.s WHERE (coalesce(c1, false) OR coalesce(c2, false) OR x.s % 10 = 0) AND coalesce(mine, 0) = coalesce(pairs, 0) AND n_full = (x.s % 10 = 0)::INT), p AS (SELECT DISTINCT c, s, a, b, e FROM x WHERE s % 10 <> 0) SELECT l_orderkey, bad.c AS course, bad.c || '-' || bad.s AS \"from\", p.c || '-' || p.s AS \"to\", faults FROM bad JOIN p ON p.c = bad.c AND p.s <> bad.s WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.l_orderkey = bad.l_orderkey AND (y.c, y.s) <> (bad.c, bad.s) AND ((y.a <= p.b AND p.a <= y.b) OR y.e = p.e))",
    "alternatives_fitting": "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, (1::BIGINT << least(l_suppkey % 24 + 2 + l_partkey % 3, 26)::INT) - (1::BIGINT << (l_suppkey % 24)::INT) AS mask FROM lineitem), k AS (SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, coalesce(bit_or(b.mask), 0) AS kept FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_partkey <> a.l_partkey GROUP BY 1, 2, 3), p AS (SELECT DISTINCT l_partkey, l_suppkey, mask FROM l WHERE l_suppkey % 10 <> 0) SELECT l_orderkey, k.l_partkey, k.l_suppkey, min(p.l_suppkey) AS \"to\" FROM k JOIN p ON p.l_partkey = k.l_partkey AND p.l_suppkey <> k.l_suppkey AND p.mask & kept = 0 GROUP BY 1, 2, 3",
    "slot_mask": f"WITH {MEETINGS} SELECT event_id, day, mask, array_to_string(list_transform(range(26), lambda i: CAST((mask >> i) & 1 AS VARCHAR)), '') AS text FROM k",
    "slot_week": f"WITH {MEETINGS} SELECT user_id, day, bit_or(mask) AS mask, bit_count(bit_or(mask))::BIGINT AS busy FROM k GROUP BY 1, 2",
    "slot_clash": f"WITH {MEETINGS}, d AS (SELECT k.*, CAST(events.ts AS DATE) AS date FROM k JOIN events USING (event_id)) SELECT x.user_id, x.date, x.event_id AS a, y.event_id AS b, x.mask & y.mask AS both FROM d x JOIN d y ON x.user_id = y.user_id AND x.date = y.date AND x.event_id < y.event_id WHERE x.mask & y.mask <> 0",
    "slot_overlap_islands": f"WITH {_RUNS} SELECT user_id, day, printf('%02d:%02d', (f * 30 + 480) // 60, (f * 30 + 480) % 60) AS begin, printf('%02d:%02d', (a * 30 + 480) // 60, (a * 30 + 480) % 60) AS \"end\" FROM r",
    "slot_profile": f"WITH {_RUNS}, g AS (SELECT *, coalesce(f - lag(a) OVER (PARTITION BY user_id, day ORDER BY f), 0) AS gap FROM r), d AS (SELECT user_id, day, max(a - f) AS run, max(gap) AS gap, min(f) AS f FROM g GROUP BY 1, 2) SELECT user_id, max(run) * 0.5::DOUBLE AS longest_hours, max(gap) * 0.5::DOUBLE AS gap_hours, count(*) AS days, max(run) * 0.5 > 6 AS w1, max(gap) * 0.5 > 4 AS w2, bool_or(f < 2) AS w3, count(*) >= 6 AS w5 FROM d GROUP BY 1",
    "interval_overlap_exact": "WITH o AS (SELECT o_custkey, o_orderpriority, o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 30 AS t FROM orders) SELECT x.o_orderkey AS a, y.o_orderkey AS b, greatest(x.f, y.f) AS from_day, least(x.t, y.t) AS to_day FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderpriority = y.o_orderpriority AND x.o_orderkey < y.o_orderkey AND x.f < y.t AND y.f < x.t",
    "exam_semi_clash": "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_custkey, count(*) AS n FROM o WHERE EXISTS (SELECT 1 FROM o p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey AND abs(p.d - o.d) < 10) GROUP BY 1",
    "lane_assign": "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 60 AS t FROM orders), b AS (SELECT *, max(t) OVER (PARTITION BY o_custkey ORDER BY f, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o), g AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR f >= before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY f, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lane_group FROM b) SELECT o_custkey, lane_group, count(*) AS n, min(f) AS from_day, max(t) AS to_day FROM g GROUP BY 1, 2",
    "rush_moves": "WITH n AS (SELECT event_id, floor(epoch(ts)) AS t, event_type, floor(epoch(lead(ts) OVER w)) AS nt, lead(event_type) OVER w AS ne, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, next_id, CAST(floor((nt - t) / 60) AS BIGINT) AS gap_minutes FROM n WHERE (nt - t) / 60 BETWEEN 0 AND 900 AND event_type <> ne",
    "time_format": "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 1440 AS m FROM orders) SELECT o_orderkey, printf('%02d:%02d', m // 60, m % 60) AS clock, m AS minutes, isodow(d) - 1 AS weekday, d + CAST((2 - (isodow(d) - 1) + 7) % 7 AS INT) AS first_wednesday, (1998 - year(d)) * 12 + 12 - month(d) AS months_old, year(d) + 543 AS be_year, strftime(d, '%Y%m%d') || 'T' || printf('%02d%02d', m // 60, m % 60) || '00' AS stamp FROM orders JOIN o USING (o_orderkey)",
    "calendar_rows": "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CAST(w AS INT) AS week, d + CAST((o_orderkey % 5 - (isodow(d) - 1) + 7) % 7 + w * 7 AS INT) AS day FROM o, range(4) t(w)",
}
