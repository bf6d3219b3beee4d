"""Registrar's pages made from orders, and read back as nested tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.sources import course_pages, table

_WEEK = ("จ.", "อังคาร", "wed", "THU", "ศ", "เสาร์", "อา.")


def _td(*cells):
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))


def _text(c):
    return c.cast("string")


def _course_html(x, i):
    """The rows that a line of an order gives: at times a level, then a section or a further meeting, at times details."""
    start = x["l_suppkey"] % 20 * 30 + 480
    clock = F.when(x["l_quantity"] > 5, F.format_string("%d:%02d-%d:%02d", F.floor(start / 60), start % 60, F.floor((start + 60) / 60), start % 60)).otherwise("N/A")
    day = F.element_at(F.array(*map(F.lit, _WEEK)), (x["l_partkey"] % 7 + 1).cast("int"))
    room, taken = F.concat(F.lit("R"), _text(x["l_suppkey"])), x["l_quantity"].cast("int")
    seats = F.concat_ws(" ", F.lit("50"), _text(taken), _text(50 - taken))
    level = F.when(i % 3 == 0, _td(F.concat(F.lit("ระดับ "), _text(x["l_linenumber"]), F.lit(": "), x["l_linestatus"], _text(x["l_suppkey"])))).otherwise("")
    own = F.when((i == 0) | (x["l_returnflag"] == "A"), _td(_text(i % 99 + 1), day, clock, room, F.lit("B1"), F.lit("C"), seats, F.lit("W"))).otherwise(_td(F.lit(""), day, clock, room, F.lit("L")))
    told = F.concat(F.lit("อาจารย์: T"), _text(x["l_suppkey"]), F.lit(", U"), _text(x["l_partkey"]), F.lit(" สอบปลายภาค: 5 กันยายน 2569 เวลา 09:00 - 12:00 อาคาร A ห้อง "), _text(x["l_linenumber"]), F.lit(" หมายเหตุ: n"))
    return F.concat(level, own, F.when(x["l_linestatus"] == "F", _td(F.lit(""), told)).otherwise(""))


def course_sections(spark, sf):
    """Each order is a course's page, its lines are sections, further meetings and details: a row for each section read."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))
    html = F.concat(F.lit("<p>04000201-62 Course วิชา สังกัด คณะ หน่วยกิต 3(2-2-5)</p><table>"), F.array_join(F.transform("x", _course_html), ""), F.lit("</table>"))
    read = course_pages.course_details(pages.select("l_orderkey", html.alias("html")), "l_orderkey", "html")
    s = read.select("l_orderkey", "course_code", F.posexplode("sections").alias("position", "s"))
    rooms = F.array_join(F.transform("s.meetings", lambda m: m["room"]), ",")
    return s.select("l_orderkey", "course_code", "position", "s.section", "s.level", F.size("s.meetings").alias("n_meetings"), F.get("s.meetings", F.lit(0))["start_min"].alias("first_start"), rooms.alias("rooms"), "s.seat_left", F.array_join("s.teachers", ",").alias("teachers"), F.col("s.final.room").alias("final_room"))


def audit_categories(spark, sf):
    """Each customer has an audit's page: priorities are categories, orders are courses. A row for each category read.

    A third of the pages state the whole degree's credits, a third those of categories, the rest neither.
    """
    o = table(spark, sf, "orders").filter("o_custkey is not null")
    grade = lambda x: F.when(x["o_orderstatus"] == "F", "A").when(x["o_orderstatus"] == "O", "F").otherwise("")
    course = lambda x: _td(F.concat(F.lpad(_text(x["o_orderkey"] % 100_000_000), 8, "0"), F.lit("-62")), F.lit("Course"), _text(x["o_orderkey"] % 3 + 1), F.concat(_text(x["o_orderkey"] % 3 + 1), F.lit("/66")), grade(x))
    parts = o.groupBy("o_custkey", "o_orderpriority").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    number = F.left("o_orderpriority", F.lit(1)).cast("int")
    heading = _td(F.concat_ws(" ", _text(number), F.substr("o_orderpriority", F.lit(3))), F.concat(F.lit("หน่วยกิตต่ำสุด : "), _text(number * 2)))
    stated = F.when(F.col("o_custkey") % 3 == 1, _text(number + F.col("o_custkey") % 7)).otherwise("-")
    boxes = F.when(number % 2 == 1, "<input type=checkbox checked>ผ่าน <input type=checkbox>ไม่ผ่าน").otherwise("<input type=checkbox>ผ่าน <input type=checkbox checked>ไม่ผ่าน")
    rows = F.concat(heading, F.array_join(F.transform("x", course), ""), _td(F.lit("รวม"), F.concat(F.lit("หน่วยกิตที่ผ่าน : "), stated), boxes))
    pages = parts.select("o_custkey", "o_orderpriority", rows.alias("rows")).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderpriority", "rows"))).alias("parts"))
    cust = F.col("o_custkey")
    head = F.concat(F.lit("<table>"), _td(F.concat(F.lpad(_text(cust), 12, "0"), F.lit("-0 Name ตรวจสอบจบ จำนวนหน่วยกิตขั้นต่ำ : 40"))), _td(F.lit("รวม"), F.concat(F.lit("หน่วยกิตที่ผ่าน : "), F.when(cust % 3 == 0, _text(cust % 50)).otherwise("-"))))
    html = F.concat(head, F.array_join(F.transform("parts", lambda p: p["rows"]), ""), F.lit("</table>"))
    read = course_pages.degree_audits(pages.select("o_custkey", html.alias("html")), "o_custkey", "html")
    c = read.select("o_custkey", "student_id", "earned_credits", "remaining_credits", F.explode("categories").alias("c"))
    passed = F.size(F.filter("c.courses", lambda x: x["passed"]))
    return c.select("o_custkey", "student_id", "earned_credits", "remaining_credits", "c.number", "c.name", "c.min_credits", "c.passed_credits", "c.is_passed", F.col("c.remaining_credits").alias("missing"), F.size("c.courses").alias("n_courses"), passed.alias("n_passed"))


QUERIES = {f.__name__: f for f in (course_sections, audit_categories)}
ORACLE_SQL = {
    "course_sections": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_returnflag, l_linestatus) - 1 AS i FROM lineitem), h AS (SELECT *, i = 0 OR l_returnflag = 'A' AS head, CASE WHEN i % 3 = 0 THEN 'ระดับ ' || l_linenumber || ': ' || l_linestatus || l_suppkey END AS lvl FROM l), c AS (SELECT *, sum(head::INT) OVER w AS s, last_value(lvl IGNORE NULLS) OVER w AS level FROM h WINDOW w AS (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT l_orderkey, '04000201-62' AS course_code, (s - 1)::INT AS position, max(lpad((i % 99 + 1)::VARCHAR, 2, '0')) FILTER (WHERE head) AS section, max(level) FILTER (WHERE head) AS level, (count(*) FILTER (WHERE l_quantity > 5))::INT AS n_meetings, (arg_min(480 + l_suppkey % 20 * 30, i) FILTER (WHERE l_quantity > 5))::INT AS first_start, coalesce(string_agg('R' || l_suppkey, ',' ORDER BY i) FILTER (WHERE l_quantity > 5), '') AS rooms, max(50 - trunc(l_quantity)::INT) FILTER (WHERE head) AS seat_left, coalesce(arg_min('T' || l_suppkey || ',U' || l_partkey, i) FILTER (WHERE l_linestatus = 'F'), '') AS teachers, arg_min(l_linenumber::VARCHAR, i) FILTER (WHERE l_linestatus = 'F') AS final_room FROM c GROUP BY l_orderkey, s",
    "audit_categories": "WITH o AS (SELECT o_custkey, left(o_orderpriority, 1)::INT AS d, substr(o_orderpriority, 3) AS name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS p, coalesce(sum(o_orderkey % 3 + 1) FILTER (WHERE o_orderstatus = 'F'), 0) AS credits FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT *, CASE WHEN o_custkey % 3 = 1 THEN d + o_custkey % 7 END AS stated, CASE o_custkey % 3 WHEN 0 THEN o_custkey % 50 WHEN 1 THEN sum(d + o_custkey % 7) OVER c ELSE sum(credits) OVER c END AS earned FROM o WINDOW c AS (PARTITION BY o_custkey)) SELECT o_custkey, lpad(o_custkey::VARCHAR, 12, '0') || '-0' AS student_id, earned::INT AS earned_credits, greatest(40 - earned, 0)::INT AS remaining_credits, d::VARCHAR AS number, name, (2 * d)::INT AS min_credits, stated::INT AS passed_credits, d % 2 = 1 AS is_passed, greatest(2 * d - coalesce(stated, credits), 0)::INT AS missing, n::INT AS n_courses, p::INT AS n_passed FROM t",
}
