"""Chunks, headings, pages, dates, calendars and other texts from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom import sinks
from termloom.functions import dates, hashing
from termloom.functions.text import WHITE
from termloom.operators import analytics, chunking
from termloom.queries.events import BOUNDS
from termloom.sources import markdown, table, timetable


def _chunk_stats(chunks):
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(F.length("chunk")), 4).alias("mean_chars"), F.min(F.length("chunk")).alias("shortest"), F.max(F.length("chunk")).alias("longest"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "chunk"))), lambda x: x["chunk"]), "\f").cast("binary")).alias("digest"))


def doc_chunks_soft(spark, sf):
    """Chunks of 420 characters that end at a line or a blank where they can."""
    return _chunk_stats(chunking.chunked(table(spark, sf, "documents").select("doc_id", "text"), "text", 420, 80))


def doc_chunks_lines(spark, sf):
    """Whole lines packed into chunks of 420 characters."""
    return _chunk_stats(chunking.chunked(table(spark, sf, "documents").select("doc_id", "text"), "text", 420, 80, chunking.whole_lines))


def markdown_chunks(spark, sf):
    """Texts whose every fourth line is made a heading of changing level: sections and their breadcrumbs."""
    docs = table(spark, sf, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    marks = F.element_at(F.array(*map(F.lit, ("#", "##", "###", "##"))), (F.floor(F.col("position") / 4) % 4 + 1).cast("int"))
    headed = F.when(F.col("position") % 4 == 0, F.concat(marks, F.lit(" T"), F.col("position").cast("string"))).otherwise(F.col("line"))
    body = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", headed.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return markdown.sections(body, "doc_id", "body").select("doc_id", "section", "breadcrumb", F.length("text").alias("chars"))


def html_rows(spark, sf):
    """One row an item or paragraph of a page, in order, without tags."""
    pattern = F.lit(r"(?s)<(li|p)>(.*?)</(?:li|p)>")
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("tag"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("body"))).alias("position", "x"))
    return rows.select("page_id", "position", "x.tag", F.regexp_extract("x.body", 'href="([^"]*)"', 1).alias("href"), F.regexp_replace("x.body", "<[^>]*>", "").alias("text"))


def dates_scalar(spark, sf):
    """Texts of dates, times and terms made from orders and read back."""
    d = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").withColumn("d", d).withColumn("m", (F.col("o_orderkey") % 900).cast("int"))
    clock = F.concat(F.format_string("%d:%02d", F.floor(F.col("m") / 60), F.col("m") % 60), F.lit(" - "), F.format_string("%d:%02d", F.floor((F.col("m") + 95) / 60), (F.col("m") + 95) % 60))
    day = F.element_at(F.array(*map(F.lit, ("mon", "Tuesday", "พ.", "THU", "ศ", "เสาร์", "อา"))), (F.weekday("d") + 1).cast("int"))
    span, week = dates.time_range(clock), dates.schedule(F.concat(day, F.lit(" "), F.regexp_replace(clock, " ", ""), F.lit("; no time here")))
    back = dates.thai_date(F.concat(F.lit("on "), dates.thai_text(F.col("d")), F.lit(" at noon")))
    return o.select("o_orderkey", back.alias("date"), span["start_min"].alias("start_min"), span["end_min"].alias("end_min"), F.size(week).alias("n_slots"), F.get(week, F.lit(0))["day"].alias("day"), dates.term(F.concat(F.lit("2/"), F.date_format("d", "yy"))).alias("term"), dates.midpoint(F.col("m"), F.col("m") + 95).alias("middle"), dates.stamp(F.col("d"), F.col("m")).alias("stamp"), dates.study_year(F.year("d") + 543, 2540).alias("study_year"), hashing.clamped(F.col("o_orderpriority"), 7, 1, 3).alias("clamped"))


def calendar_ics(spark, sf):
    """One calendar text an order: a weekly event for each of its lines until the date of shipping."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("; x,y")).alias("title"), F.when(F.col("l_returnflag") == "R", "Hall").alias("location"), (F.col("l_partkey") % 7).cast("int").alias("day"), (F.col("l_linenumber") * 60).cast("int").alias("start_min"), (F.col("l_linenumber") * 60 + 50).cast("int").alias("end_min"), F.to_date("o_orderdate").alias("from_date"), F.date_add(F.to_date("o_orderdate"), 5).alias("to_date"))
    return sinks.calendar(m.withColumn("position", (F.col("k.l_linenumber") * 10000000 + F.col("k.l_partkey")).cast("int")).drop("k"), "l_orderkey", "-//plan//EN").select("l_orderkey", F.md5(F.col("ics").cast("binary")).alias("digest"), (F.size(F.split("ics", "BEGIN:VEVENT")) - 1).alias("events"))


def metrics_lines(spark, sf):
    return sinks.metric_lines(analytics.cumulative_histogram(table(spark, sf, "events"), "event_type", "value", BOUNDS), "event_value", "event_type")


def message_last_write(spark, sf):
    """Each conversation's last turn stands for its message."""
    return sinks.last_write(table(spark, sf, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", F.length("text").alias("chars"))


def section_faults(spark, sf):
    """Orders as sections, lines as meetings: how many can't be used, and why."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    m = F.struct((F.col("l_partkey") % 9).cast("int").alias("day"), (n * 60).cast("int").alias("start_min"), (n * 60 + q - 2).cast("int").alias("end_min"))
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "N", m)).alias("meetings"))
    own = own.withColumn("is_online", F.col("l_orderkey") % 4 == 0).withColumn("exams", F.array(F.struct(F.lit(0).alias("start_min"), (F.col("l_orderkey") % 50).cast("int").alias("end_min"))))
    _, bad = timetable.validated(own)
    return bad.groupBy("fault").agg(F.count("*").alias("n"))


def masked_users(spark, sf):
    """Users under a keyed hash, with a key of their payload that does not depend on the order of its fields."""
    ev = table(spark, sf, "events").filter("user_id is not null")
    return ev.select("event_id", hashing.masked_id(F.col("user_id").cast("string"), b"key of the tests").alias("user"), hashing.cache_key("events", {"type": F.col("event_type"), "id": F.col("event_id")}).alias("key"))


QUERIES = {f.__name__: f for f in (doc_chunks_soft, doc_chunks_lines, markdown_chunks, html_rows, dates_scalar, calendar_ics, metrics_lines, message_last_write, section_faults, masked_users)}

_STAMP = "strftime({d}, '%Y%m%d') || 'T' || printf('%02d%02d00', {m} // 60, {m} % 60)"
_WHITE = "'" + WHITE + "'"
_END = "CASE WHEN length(t) - s <= 420 THEN length(t) WHEN contains(substr(t, s + 211, 210), chr(10)) THEN s + 420 - instr(reverse(substr(t, s + 211, 210)), chr(10)) WHEN contains(substr(t, s + 211, 210), ' ') THEN s + 420 - instr(reverse(substr(t, s + 211, 210)), ' ') ELSE s + 420 END"
_FIRST = "f + CAST((day - (isodow(f) - 1) + 7) % 7 AS INT)"
ORACLE_SQL = {
    "doc_chunks_soft": f"WITH RECURSIVE d AS (SELECT doc_id, trim(text, {_WHITE}) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, t, s, {_END} AS e FROM (SELECT doc_id, t, 0::BIGINT AS s FROM d WHERE t <> '') UNION ALL SELECT doc_id, t, s, {_END} AS e FROM (SELECT doc_id, t, greatest(e - 80, s + 1) AS s FROM c WHERE e < length(t))), k AS (SELECT doc_id, s, trim(substr(t, s + 1, e - s), {_WHITE}) AS chunk FROM c) SELECT doc_id, count(*) AS n, round(avg(length(chunk)), 4) AS mean_chars, min(length(chunk)) AS shortest, max(length(chunk)) AS longest, md5(string_agg(chunk, chr(12) ORDER BY s)) AS digest FROM k WHERE chunk <> '' GROUP BY 1",
    "markdown_chunks": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, p // 4 + 1 AS section, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE p % 4 <> 0) AS text FROM l GROUP BY 1, 2), b AS (SELECT *, section - 1 AS k FROM s) SELECT doc_id, section, CASE k % 4 WHEN 0 THEN 'T' || 4 * k WHEN 1 THEN 'T' || 4 * (k - 1) || ' > T' || 4 * k WHEN 2 THEN 'T' || 4 * (k - 2) || ' > T' || 4 * (k - 1) || ' > T' || 4 * k ELSE 'T' || 4 * (k - 3) || ' > T' || 4 * k END AS breadcrumb, length(trim(coalesce(text, ''), ' '))::INT AS chars FROM b",
    "html_rows": "WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<(li|p)>(.*?)</(?:li|p)>', 1) AS t, regexp_extract_all(html, '(?s)<(li|p)>(.*?)</(?:li|p)>', 2) AS b FROM pages), r AS (SELECT page_id, unnest(t) AS tag, unnest(b) AS body, unnest(range(len(t))) AS position FROM x) SELECT page_id, position::INT AS position, tag, regexp_extract(body, 'href=\"([^\"]*)\"', 1) AS href, regexp_replace(body, '<[^>]*>', '', 'g') AS text FROM r",
    "dates_scalar": f"WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 900 AS INT) AS m, o_orderpriority AS p FROM orders) SELECT o_orderkey, d AS date, m AS start_min, m + 95 AS end_min, 1 AS n_slots, (isodow(d) - 1)::INT AS day, '2/25' || strftime(d, '%y') AS term, ((2 * m + 95) // 60 * 30)::INT AS middle, {_STAMP.format(d='d', m='m')} AS stamp, greatest(1, 2540 - (year(d) + 543) + 1)::INT AS study_year, 7 AS clamped FROM o",
    "calendar_ics": f"WITH m AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS position, 'P' || l_partkey || '\\; x\\,y' AS title, CASE WHEN l_returnflag = 'R' THEN 'LOCATION:Hall' || chr(13) || chr(10) ELSE '' END AS loc, l_partkey % 7 AS day, l_linenumber * 60 AS s, CAST(o_orderdate AS DATE) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey), e AS (SELECT *, {_FIRST} AS d FROM m), t AS (SELECT l_orderkey, string_agg(CASE WHEN d <= f + 5 THEN 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || l_orderkey || '-' || position || chr(13) || chr(10) || 'SUMMARY:' || title || chr(13) || chr(10) || loc || 'DTSTART:' || {_STAMP.format(d='d', m='s')} || chr(13) || chr(10) || 'DTEND:' || {_STAMP.format(d='d', m='(s + 50)')} || chr(13) || chr(10) || 'RRULE:FREQ=WEEKLY;BYDAY=' || ['MO', 'TU', 'WE', 'TH', 'FR', 'SA', 'SU'][day + 1] || ';UNTIL=' || strftime(f + 5, '%Y%m%d') || 'T235959' || chr(13) || chr(10) || 'END:VEVENT' || chr(13) || chr(10) ELSE '' END, '' ORDER BY position, loc) AS body, count(*) FILTER (WHERE d <= f + 5) AS n FROM e GROUP BY 1) SELECT l_orderkey, md5('BEGIN:VCALENDAR' || chr(13) || chr(10) || 'PRODID:-//plan//EN' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || body || 'END:VCALENDAR' || chr(13) || chr(10)) AS digest, n::INT AS events FROM t",
    "metrics_lines": "WITH h AS (SELECT event_type, b.bound, b.le, count(*) FILTER (WHERE value <= b.le) AS n FROM events, (VALUES ('10.0', 10), ('25.0', 25), ('50.0', 50), ('100.0', 100), ('200.0', 200), ('+Inf', 'Infinity'::DOUBLE)) AS b(bound, le) GROUP BY 1, 2, 3) SELECT event_type, string_agg('event_value_bucket{event_type=\"' || event_type || '\",le=\"' || bound || '\"} ' || n, chr(10) ORDER BY le) AS lines FROM h GROUP BY 1",
    "message_last_write": "SELECT conv_id, turn, role, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "section_faults": "WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'N' AND l_partkey % 9 > 6) AS bad, count(*) FILTER (WHERE l_returnflag = 'N' AND CAST(trunc(l_quantity) AS INT) <= 2) AS back FROM lineitem GROUP BY 1), f AS (SELECT CASE WHEN n = 0 AND l_orderkey % 4 <> 0 THEN 'no meetings' WHEN bad > 0 THEN 'bad day' WHEN back > 0 THEN 'meeting ends before it starts' WHEN l_orderkey % 50 <= 0 THEN 'exam ends before it starts' END AS fault FROM s) SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1",
}
