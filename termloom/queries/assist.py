"""Questions, plans and payloads: variants, topics, tools, scrubbing, streamed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import planning, questions
from termloom.sources import sse, table, transcript

#: English stand-ins for the topic table: the words of the tables are invented. (topic, words, what is added)
TOPICS = [("graduate", ["the end", "with the"], "degree total credits"), ("term_credits", ["of the"], "credits a term"), ("credits", ["the"], "credits"), ("clash", ["and a", "is a"], "times that clash"), ("exam", [" in "], "exam calendar")]
#: Intents with their keywords, the slots they need and their tools by stage.
INTENT_SLOTS = {"PLAN": ["term", "day"], "CHECK": ["code"], "ASK": []}
INTENT_TOOLS = {"PLAN": [["context"], ["catalog", "rules"], ["plan"]], "CHECK": [["catalog"], ["check"]], "ASK": [["search"]]}


def _asked(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def query_variants(spark, sf):
    """Wordings of each question: short ones get context, long ones lose polite words."""
    q = _asked(spark, sf).select("conv_id", "turn", questions.variants(F.col("text"), ["{} what is it", "{} how to use it", "meaning of {}"], ["and", "of", "the"]).alias("v"))
    return q.select("conv_id", "turn", F.size("v").alias("n"), F.array_join("v", "|").alias("variants"))


def expand_topics(spark, sf):
    """The additions of each topic that a question names; the general credits topic gives way to a special one."""
    found = _asked(spark, sf).select("conv_id", "turn", questions.topics(F.lower("text"), TOPICS, {"credits": ["graduate", "term_credits"]}).alias("t"))
    return found.select("conv_id", "turn", F.array_join("t", "; ").alias("added"))


def tool_plan(spark, sf):
    """Intent by first keyword, slots found and missing, the tools by stage; a plan with missing slots asks back."""
    t = F.lower("text")
    intent = F.when(F.contains(t, F.lit("with")), "PLAN").when(F.contains(t, F.lit("is")), "CHECK").otherwise("ASK")
    slots = F.filter(F.array(F.when(F.contains(t, F.lit("term")), "term"), F.when(t.rlike("[0-9]{2,}"), "code"), F.when(F.contains(t, F.lit("day")), "day")), lambda x: x.isNotNull())
    own = _asked(spark, sf).select("conv_id", "turn", intent.alias("intent"), slots.alias("slots"))
    planned = questions.tool_plan(own, "intent", "slots", INTENT_SLOTS, INTENT_TOOLS)
    return planned.select("conv_id", "turn", "intent", F.array_join("missing", ",").alias("missing"), "stages", "action")


def payload_scrub_deep(spark, sf):
    """A payload around each event and its props: sensitive keys go at any depth, texts are scrubbed, all else stays."""
    ev = table(spark, sf, "events")
    mail = F.concat(F.lit("u"), F.coalesce(F.col("user_id").cast("string"), F.lit("nobody")), F.lit("@example.org"))
    told = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("call 081-234-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("room "), (F.col("event_id") % 1000).cast("string")))
    rest = F.struct(F.struct(F.col("event_id").alias("id"), mail.alias("Email"), F.struct(mail.alias("note"), F.col("value").alias("token")).alias("inner")).alias("outer"), F.array(F.struct(F.concat(told, F.lit(" "), "event_type").alias("text"))).alias("list"))
    payload = F.concat(F.lit('{"props": ['), F.coalesce("props", F.lit("null")), F.lit('], "body": '), F.to_json(rest), F.lit("}"))
    clean = X.scrub_json(payload)
    get = lambda p: F.get_json_object(clean, p)
    return ev.select("event_id", get("$.body.outer.id").cast("long").alias("id"), get("$.body.outer.Email").isNull().alias("no_mail"), get("$.body.outer.inner.note").alias("note"), get("$.body.outer.inner.token").isNull().alias("no_token"), get("$.body.list[0].text").alias("text"), get("$.props[0].k").cast("long").alias("k"))


def sse_parse(spark, sf):
    """Each conversation as a stream of server-sent events, and what a reader of it gets back."""
    t = table(spark, sf, "conversations")
    line = sse.encode(F.when(F.col("role") == "assistant", "token").otherwise("context"), F.struct("turn", "role", F.col("text")))
    stream = t.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("stream"))
    body = F.concat(F.lit(": ping\n\n"), "stream", F.lit("data: not json\n\nevent: done\ndata: {}\n\n"))
    rows = sse.parse(stream.select("conv_id", body.alias("stream")), "stream")
    return rows.groupBy("conv_id").agg(F.count_if(F.col("event") == "token").alias("tokens"), F.count_if(F.col("event") == "context").alias("contexts"), F.count_if(F.col("event") == "done").alias("done"), F.sum(F.length(F.get_json_object("data", "$.text"))).alias("chars"))


def text_rows_parse(spark, sf):
    """Order lines written as CSV with a header, and as free text, read back by both parsers."""
    grade = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "F").otherwise("B+")
    code = F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit("-62"))
    credit = (F.col("l_linenumber") % 6 + 1).cast("string")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", code, F.lit('"a, b"'), credit, grade).alias("csv"), F.concat_ws(" ", code, F.lit("name"), credit, grade).alias("line"))
    texts = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "csv", "line"))).alias("rows"))
    texts = texts.select("l_orderkey", F.concat(F.lit("Course_Code,Name,Credits,Grade\n"), F.array_join(F.transform("rows", lambda r: r["csv"]), "\n")).alias("csv"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    a = transcript.from_csv_text(texts, "csv").groupBy("l_orderkey").agg(F.count("*").alias("csv_rows"), F.sum("credits").alias("csv_credits"), F.count_if(F.col("grade") == "F").alias("csv_failed"))
    b = transcript.from_free_text(texts, "text").groupBy("l_orderkey").agg(F.count("*").alias("text_rows"), F.sum("credits").alias("text_credits"), F.count_if(F.col("grade") == "F").alias("text_failed"))
    return a.join(b, "l_orderkey")


def nested_projection(spark, sf):
    """Orders with their lines renamed, pruned and nested; seats left are never below 0; fields are read back from JSON."""
    line = F.struct(F.col("l_linenumber").alias("position"), F.upper(F.trim("l_returnflag")).alias("code"), F.greatest(F.lit(50.0) - F.col("l_quantity"), F.lit(0.0)).alias("left"))
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("items"))
    o = table(spark, sf, "orders").filter(F.upper(F.trim("o_orderstatus")) == "O").join(own, F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderpriority").alias("level")).alias("meta"), "items"))
    j = lambda p: F.get_json_object(body, p)
    return o.select("o_orderkey", j("$.meta.level").alias("level"), F.size("items").alias("n_items"), j("$.items[0].position").cast("int").alias("first_position"), j("$.items[0].code").alias("first_code"), F.round(F.aggregate("items", F.lit(0.0), lambda s, x: s + x["left"]), 2).alias("left"))


def relaxed_plan(spark, sf):
    """Per customer the first rule set that leaves a plan: strict, without preference, full lines too, no minimum."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pool = lines.select("o_custkey", (-F.col("l_discount")).alias("rank"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.pow(F.lit(2.0), F.col("l_partkey") % 26).cast("long").alias("mask"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), (F.col("l_returnflag") == "R").alias("preferred"), (F.col("l_quantity") >= 45).alias("full"))
    return planning.relaxed(pool, "o_custkey", ["rank", "l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", "mask", "item", 60.0, 50.0, [("strict", "preferred and not full", True), ("no_preferences", "not full", True), ("full_allowed", "true", True), ("no_minimum", "true", False)])


QUERIES = {f.__name__: f for f in (query_variants, expand_topics, tool_plan, payload_scrub_deep, sse_parse, text_rows_parse, nested_projection, relaxed_plan)}

_Q = "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'"
_TOPIC = {name: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")" for name, words, _ in TOPICS}
ORACLE_SQL = {
    "query_variants": f"WITH q AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM ({_Q})), s AS (SELECT *, trim(regexp_replace(regexp_replace(b, '\\b(and|of|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM q), v AS (SELECT conv_id, turn, CASE WHEN length(b) <= 18 THEN [b, b || ' what is it', b || ' how to use it', 'meaning of ' || b] WHEN s <> '' AND s <> b THEN [b, s] ELSE [b] END AS v FROM s) SELECT conv_id, turn, len(v)::INT AS n, array_to_string(v, '|') AS variants FROM v",
    "expand_topics": f"SELECT conv_id, turn, concat_ws('; ', CASE WHEN {_TOPIC['graduate']} THEN 'degree total credits' END, CASE WHEN {_TOPIC['term_credits']} THEN 'credits a term' END, CASE WHEN {_TOPIC['credits']} AND NOT {_TOPIC['graduate']} AND NOT {_TOPIC['term_credits']} THEN 'credits' END, CASE WHEN {_TOPIC['clash']} THEN 'times that clash' END, CASE WHEN {_TOPIC['exam']} THEN 'exam calendar' END) AS added FROM ({_Q})",
    "tool_plan": f"WITH i AS (SELECT conv_id, turn, lower(text) AS t FROM ({_Q})), k AS (SELECT conv_id, turn, CASE WHEN contains(t, 'with') THEN 'PLAN' WHEN contains(t, 'is') THEN 'CHECK' ELSE 'ASK' END AS intent, contains(t, 'term') AS term, regexp_matches(t, '[0-9]{{2,}}') AS code, contains(t, 'day') AS d FROM i), m AS (SELECT conv_id, turn, intent, CASE intent WHEN 'PLAN' THEN concat_ws(',', CASE WHEN NOT term THEN 'term' END, CASE WHEN NOT d THEN 'day' END) WHEN 'CHECK' THEN concat_ws(',', CASE WHEN NOT code THEN 'code' END) ELSE '' END AS missing FROM k) SELECT conv_id, turn, intent, missing, CASE intent WHEN 'PLAN' THEN 'context > catalog+rules > plan' WHEN 'CHECK' THEN 'catalog > check' ELSE 'search' END AS stages, CASE WHEN missing <> '' THEN 'clarify' ELSE 'run' END AS action FROM m",
    "payload_scrub_deep": "SELECT event_id, event_id::BIGINT AS id, true AS no_mail, '[EMAIL]' AS note, true AS no_token, CASE WHEN user_id % 2 = 0 THEN 'call [PHONE] ' ELSE 'room ' || (event_id % 1000) || ' ' END || event_type AS text, (props->>'$.k')::BIGINT AS k FROM events",
    "sse_parse": "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS tokens, count(*) FILTER (WHERE role IS DISTINCT FROM 'assistant') AS contexts, 1::BIGINT AS done, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
    "text_rows_parse": "SELECT l_orderkey, count(*) AS csv_rows, sum(l_linenumber % 6 + 1)::BIGINT AS csv_credits, count(*) FILTER (WHERE l_returnflag = 'R') AS csv_failed, count(*) AS text_rows, sum(l_linenumber % 6 + 1)::BIGINT AS text_credits, count(*) FILTER (WHERE l_returnflag = 'R') AS text_failed FROM lineitem GROUP BY 1",
    "nested_projection": "WITH i AS (SELECT l_orderkey, count(*)::INT AS n, arg_min(l_returnflag, (l_linenumber, upper(trim(l_returnflag)), greatest(50 - l_quantity, 0))) AS c, min(l_linenumber) AS p, round(sum(greatest(50 - l_quantity, 0)), 2) AS l FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderpriority AS level, n AS n_items, p::INT AS first_position, c AS first_code, l AS left FROM orders JOIN i ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'",
}
