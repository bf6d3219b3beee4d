"""Lookups, nested rows, rules and rankings on the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.sources import table

#: Ids that a client asks for, in its order; some are unknown.
ASKED = [7, 3, 999999999, 12, 3, 25]


def catalog_search_page(spark, sf):
    """Text in name or type, first part of each brand, second page of ten."""
    q = F.lit("a")
    parts = table(spark, sf, "part").filter(F.contains(F.lower("p_name"), q) | F.contains(F.lower("p_type"), q))
    first = parts.groupBy("p_brand").agg(F.min_by(F.struct("p_partkey", "p_name"), "p_partkey").alias("one"))
    return first.select("p_brand", "one.*").orderBy("p_brand").offset(10).limit(10)


def catalog_nested(spark, sf):
    lines = table(spark, sf, "lineitem")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))
    kept = nested.filter(F.exists("lines", lambda x: x["l_quantity"] >= 45))
    return kept.select("l_orderkey", F.size("lines").alias("n_lines"), F.element_at("lines", 1)["l_quantity"].alias("first_quantity"), F.element_at("lines", -1)["l_quantity"].alias("last_quantity"))


def _asked(spark):
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, ASKED))).alias("pos", "c_custkey"))


def lookup_ordered(spark, sf):
    return _asked(spark).join(table(spark, sf, "customer"), "c_custkey").select("pos", "c_custkey", "c_name")


def lookup_missing(spark, sf):
    return _asked(spark).join(table(spark, sf, "customer"), "c_custkey", "left_anti").select("pos", "c_custkey")


def left_attach_collect(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("o_orderkey")), 1, 5), lambda x: x.cast("string")), ",").alias("first_orders"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("first_orders", F.lit("")).alias("first_orders"))


def plan_totals(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_distinct("l_partkey").alias("n_parts"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))
    return table(spark, sf, "orders").join(lines, "o_orderkey").select("o_orderkey", "n_items", "quantity", "n_parts", "any_returned")


def ownership_status(spark, sf):
    """Is an order there, and does its customer belong to nation 3?"""
    known = table(spark, sf, "orders").select("o_orderkey")
    asked = known.union(known.select(-F.col("o_orderkey")))  # every order, and as many keys that are unknown
    found = asked.join(table(spark, sf, "orders"), "o_orderkey", "left").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return found.select("o_orderkey", F.when(F.col("o_custkey").isNull(), 404).when(F.col("c_nationkey") == 3, 200).otherwise(403).alias("status"))


def anti_prereq(spark, sf):
    """Parts that customers of segment BUILDING would need but never ordered, of a required set."""
    need = table(spark, sf, "part").filter("p_partkey <= 20").select("p_partkey")
    who = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    had = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    # the required set is the query's constant, at most 20 rows
    return who.crossJoin(F.broadcast(need)).join(had, ["c_custkey", "p_partkey"], "left_anti").groupBy("c_custkey").agg(F.count("*").alias("n_missing"), F.min("p_partkey").alias("first_missing"))


def semi_passed(spark, sf):
    had = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(had, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"))


def group_duplicate(spark, sf):
    """Orders that hold a supplier more than once, its lines in order."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines")).filter(F.size("lines") > 1)
    return g.select("l_orderkey", "l_suppkey", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def credit_bounds(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return q.select("l_orderkey", "total", F.when(F.col("total") > 200, "over").when(F.col("total") < 20, "under").otherwise("ok").alias("status"), F.when(F.col("total") > 200, F.round(F.col("total") - 200, 2)).when(F.col("total") < 20, F.round(20 - F.col("total"), 2)).otherwise(0.0).alias("distance"))


def findings_rollup(spark, sf):
    """Findings of three rules in one table, then a verdict for each order."""
    lines = table(spark, sf, "lineitem")
    twice = lines.groupBy("l_orderkey", "l_partkey").count().filter("count > 1").select("l_orderkey", F.lit("C5").alias("code"), F.lit("ERROR").alias("severity"))
    full = lines.filter("l_quantity >= 50").select("l_orderkey", F.lit("C6"), F.lit("ERROR"))
    low = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).filter("q < 10").select("l_orderkey", F.lit("C4"), F.lit("WARNING"))
    found = twice.union(full).union(low).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "ERROR").alias("error"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return table(spark, sf, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_findings"), F.when(F.col("error"), "blocked").when(F.col("n") > 0, "warning").otherwise("ok").alias("verdict"), F.coalesce("codes", F.lit("")).alias("codes"))


def gpax_weighted(spark, sf):
    """Discount bands as grades, quantities as credits; bands without points count in neither sum."""
    point = F.when(F.col("l_discount") < 0.02, 4.0).when(F.col("l_discount") < 0.05, 3.0).when(F.col("l_discount") < 0.08, 2.0)
    own = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("point", point)
    return own.groupBy("o_custkey").agg(F.sum("l_quantity").alias("attempted"), F.round(F.sum(F.col("point") * F.col("l_quantity")) / F.sum(F.when(F.col("point").isNotNull(), F.col("l_quantity"))), 4).alias("gpax"), F.count_if(F.col("point").isNull()).alias("ungraded"))


def category_progress(spark, sf):
    least = {"BUILDING": 1e6, "MACHINERY": 5e7, "AUTOMOBILE": 2e9}
    minimum = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    got = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))), 2).alias("got"))
    return got.withColumn("minimum", minimum[F.col("c_mktsegment")]).filter("minimum is not null").withColumn("remaining", F.round(F.greatest(F.col("minimum") - F.col("got"), F.lit(0.0)), 2))


def crosstab_month(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


def multi_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count_distinct("l_partkey").alias("parts"))


def first_per_key(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("o_custkey", "o_orderkey", "o_orderpriority")


def candidate_priority(spark, sf):
    """Priority by rules, then a sort of mixed directions that numbers the rows."""
    p = F.when(F.col("p_size") >= 45, 0).when(F.col("p_type").startswith("PROMO"), 1).when(F.col("p_retailprice") > 1500, 2).otherwise(3)
    w = Window.partitionBy("p_brand").orderBy("priority", F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").withColumn("priority", p).withColumn("place", F.row_number().over(w)).filter("place <= 5").select("p_brand", "p_partkey", "priority", "place")


def sorts_misc(spark, sf):
    """Newest first with ties by id, a filter before the limit, and how many it left out."""
    orders = table(spark, sf, "orders")
    kept = F.col("o_orderstatus") == "O"
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    top = orders.filter(kept).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_orderpriority", "o_orderkey", F.col("rn"))
    out = orders.groupBy("o_orderpriority").agg(F.count_if(~kept).alias("left_out"))
    return top.join(out, "o_orderpriority")


def alternatives(spark, sf):
    """For each returned line the cheapest other supplier of the same part."""
    lines = table(spark, sf, "lineitem")
    asked = lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("own"))
    other = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"))
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("price", "l_suppkey")
    return asked.join(other, "l_partkey").filter("l_suppkey <> own").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("l_orderkey", "l_linenumber", "l_suppkey", "price")


def array_ops(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_suppkey"))).alias("x"))
    flags = F.transform("x", lambda r: r["l_returnflag"])
    even = F.filter(flags, lambda v, i: i % 2 == 0)
    return own.select("l_orderkey", F.array_join(F.array_distinct(flags), "").alias("distinct_flags"), F.array_join(even, "").alias("even_flags"), F.array_join(F.slice(flags, F.greatest(F.size(flags) - 2, F.lit(1)), F.lit(3)), "").alias("last_three"), F.array_join(F.sort_array(F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("R")), flags)), "").alias("absent"), F.element_at(F.col("x"), -1)["l_suppkey"].alias("last_supplier"))


def context_row(spark, sf):
    """One wide row a customer, defaults for unknown ids."""
    known = table(spark, sf, "customer").select("c_custkey")
    asked = known.union(known.select(-F.col("c_custkey")))  # every customer, and as many that are unknown
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count_if(F.expr("o_orderstatus = 'P'")).alias("pending"))
    return asked.join(table(spark, sf, "customer"), "c_custkey", "left").join(spent, "c_custkey", "left").select("c_custkey", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.col("c_name").isNull().alias("is_default"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), F.coalesce("pending", F.lit(0)).alias("pending"))


def alerts_rules(spark, sf):
    """Lines that ship 7, 3 or 1 days after a day, few pieces, and a big order: one alert a subject, code and day."""
    day = F.to_date(F.lit("1995-06-15"))
    lines = table(spark, sf, "lineitem").withColumn("days", F.datediff(F.to_date("l_shipdate"), day))
    soon = lines.filter(F.col("days").isin(7, 3, 1)).select("l_orderkey", F.lit("A1").alias("code"))
    window = lines.filter(F.col("days").between(0, 7) & (F.col("l_returnflag") == "R")).select("l_orderkey", F.lit("A2"))
    few = lines.filter((F.col("days").between(0, 30)) & (F.col("l_quantity") <= 2)).select("l_orderkey", F.lit("A3"))
    return soon.union(window).union(few).withColumn("dedup_key", F.concat_ws(":", F.col("l_orderkey").cast("string"), "code", F.date_format(day, "yyyy-MM-dd"))).dropDuplicates(["dedup_key"]).groupBy("code").agg(F.count("*").alias("n"), F.min("dedup_key").alias("first_key"))


def replace_by_key(spark, sf):
    """A draft keeps one line of each part: new lines replace old ones."""
    lines = table(spark, sf, "lineitem")
    old, new = lines.filter("l_linenumber <= 3"), lines.filter("l_linenumber > 3")
    kept = old.join(new.select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_suppkey", "l_linenumber")
    return kept.unionByName(new.select("l_orderkey", "l_suppkey", "l_linenumber")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("line_sum"))


QUERIES = {f.__name__: f for f in (catalog_search_page, catalog_nested, lookup_ordered, lookup_missing, left_attach_collect, plan_totals, ownership_status, anti_prereq, semi_passed, group_duplicate, credit_bounds, findings_rollup, gpax_weighted, category_progress, crosstab_month, multi_agg, first_per_key, candidate_priority, sorts_misc, alternatives, array_ops, context_row, alerts_rules, replace_by_key)}

_ASKED = ", ".join(f"({i}, {x})" for i, x in enumerate(ASKED))
ORACLE_SQL = {
    "catalog_search_page": "WITH f AS (SELECT * FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')) SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM f GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 10",
    "catalog_nested": "SELECT l_orderkey, count(*) AS n_lines, list(l_quantity ORDER BY l_linenumber, l_quantity, l_returnflag)[1] AS first_quantity, list(l_quantity ORDER BY l_linenumber, l_quantity, l_returnflag)[-1] AS last_quantity FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 45",
    "lookup_ordered": f"SELECT a.pos, c_custkey, c_name FROM (VALUES {_ASKED}) AS a(pos, id) JOIN customer ON c_custkey = a.id",
    "lookup_missing": f"SELECT a.pos, a.id AS c_custkey FROM (VALUES {_ASKED}) AS a(pos, id) ANTI JOIN customer ON c_custkey = a.id",
    "left_attach_collect": "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL))[1:5], ','), '') AS first_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "plan_totals": "SELECT o_orderkey, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_partkey) AS n_parts, bool_or(l_returnflag = 'R') AS any_returned FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "ownership_status": "WITH a AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey FROM orders) SELECT k AS o_orderkey, CASE WHEN o_custkey IS NULL THEN 404 WHEN c_nationkey = 3 THEN 200 ELSE 403 END AS status FROM a LEFT JOIN orders ON o_orderkey = k LEFT JOIN customer ON c_custkey = o_custkey",
    "anti_prereq": "WITH had AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT c_custkey, count(*) AS n_missing, min(p_partkey) AS first_missing FROM customer, part WHERE c_mktsegment = 'BUILDING' AND p_partkey <= 20 AND NOT EXISTS (SELECT 1 FROM had WHERE o_custkey = c_custkey AND l_partkey = p_partkey) GROUP BY 1",
    "semi_passed": "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "group_duplicate": "SELECT l_orderkey, l_suppkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "credit_bounds": "SELECT l_orderkey, t AS total, CASE WHEN t > 200 THEN 'over' WHEN t < 20 THEN 'under' ELSE 'ok' END AS status, CASE WHEN t > 200 THEN round(t - 200, 2) WHEN t < 20 THEN round(20 - t, 2) ELSE 0.0::DOUBLE END AS distance FROM (SELECT l_orderkey, round(sum(l_quantity), 2) AS t FROM lineitem GROUP BY 1)",
    "findings_rollup": "WITH f AS (SELECT l_orderkey, 'C5' AS code, 'ERROR' AS severity FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1 UNION ALL SELECT l_orderkey, 'C6', 'ERROR' FROM lineitem WHERE l_quantity >= 50 UNION ALL SELECT l_orderkey, 'C4', 'WARNING' FROM lineitem GROUP BY 1 HAVING sum(l_quantity) < 10) SELECT o_orderkey, count(code) AS n_findings, CASE WHEN bool_or(severity = 'ERROR') THEN 'blocked' WHEN count(code) > 0 THEN 'warning' ELSE 'ok' END AS verdict, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1",
    "gpax_weighted": "WITH p AS (SELECT o_custkey, l_quantity AS q, CASE WHEN l_discount < 0.02 THEN 4 WHEN l_discount < 0.05 THEN 3 WHEN l_discount < 0.08 THEN 2 END AS point FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT o_custkey, sum(q) AS attempted, round(sum(point * q) / sum(q) FILTER (WHERE point IS NOT NULL), 4) AS gpax, count(*) FILTER (WHERE point IS NULL) AS ungraded FROM p GROUP BY 1",
    "category_progress": "WITH m(c_mktsegment, minimum) AS (VALUES ('BUILDING', 1e6), ('MACHINERY', 5e7), ('AUTOMOBILE', 2e9)), g AS (SELECT c_mktsegment, round(sum(coalesce(o_totalprice, 0)), 2) AS got FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_mktsegment, got, minimum, round(greatest(minimum - got, 0), 2) AS remaining FROM g JOIN m USING (c_mktsegment)",
    "crosstab_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "multi_agg": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2",
    "first_per_key": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "candidate_priority": "WITH p AS (SELECT *, CASE WHEN p_size >= 45 THEN 0 WHEN starts_with(p_type, 'PROMO') THEN 1 WHEN p_retailprice > 1500 THEN 2 ELSE 3 END AS priority FROM part) SELECT * FROM (SELECT p_brand, p_partkey, priority, row_number() OVER (PARTITION BY p_brand ORDER BY priority, p_retailprice DESC, p_partkey) AS place FROM p) WHERE place <= 5",
    "sorts_misc": "WITH o AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'O') AS left_out FROM orders GROUP BY 1), t AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O') SELECT t.*, left_out FROM t JOIN o USING (o_orderpriority) WHERE rn <= 3",
    "alternatives": "WITH o AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2) SELECT a.l_orderkey, a.l_linenumber, o.l_suppkey, price FROM lineitem a JOIN o ON o.l_partkey = a.l_partkey AND o.l_suppkey <> a.l_suppkey WHERE a.l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY price, o.l_suppkey) = 1",
    "array_ops": "WITH x AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_suppkey) AS f, list(l_suppkey ORDER BY l_linenumber, l_returnflag, l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(list_filter(list_zip(f, range(len(f))), lambda p: list_position(f, p[1]) = p[2] + 1), lambda p: p[1]), '') AS distinct_flags, array_to_string(list_transform(list_filter(list_zip(f, range(len(f))), lambda p: p[2] % 2 = 0), lambda p: p[1]), '') AS even_flags, array_to_string(f[greatest(len(f) - 2, 1):], '') AS last_three, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda v: NOT list_contains(f, v))), '') AS absent, s[-1] AS last_supplier FROM x",
    "context_row": "WITH s AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1) SELECT k AS c_custkey, coalesce(c_name, 'unknown') AS name, c_name IS NULL AS is_default, coalesce(n, 0) AS n_orders, coalesce(spent, 0) AS spent, coalesce(pending, 0) AS pending FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT -c_custkey FROM customer) LEFT JOIN customer ON c_custkey = k LEFT JOIN s ON o_custkey = k",
    "alerts_rules": "WITH d AS (SELECT *, date_diff('day', DATE '1995-06-15', CAST(l_shipdate AS DATE)) AS days FROM lineitem), a AS (SELECT l_orderkey, 'A1' AS code FROM d WHERE days IN (7, 3, 1) UNION SELECT l_orderkey, 'A2' FROM d WHERE days BETWEEN 0 AND 7 AND l_returnflag = 'R' UNION SELECT l_orderkey, 'A3' FROM d WHERE days BETWEEN 0 AND 30 AND l_quantity <= 2) SELECT code, count(*) AS n, min(l_orderkey || ':' || code || ':1995-06-15') AS first_key FROM a GROUP BY 1",
    "replace_by_key": "WITH l AS (SELECT * FROM lineitem), n AS (SELECT * FROM l WHERE l_linenumber > 3), u AS (SELECT l_orderkey, l_linenumber FROM l WHERE l_linenumber <= 3 AND NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = l.l_orderkey AND n.l_suppkey = l.l_suppkey) UNION ALL SELECT l_orderkey, l_linenumber FROM n) SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS line_sum FROM u GROUP BY 1",
}
