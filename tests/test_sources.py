"""Readers, parsers and sinks on literal rows."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from termloom import sinks, streaming
from termloom.functions import dates, hashing
from termloom.functions import text as X
from termloom.operators import chunking, graph, planning, questions
from termloom.sources import commits, markdown, registrar, sse, timetable, transcript


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_dates(spark):
    row = spark.range(1).select(
        dates.day_number(F.lit(" พฤ. ")).alias("thu"), dates.day_number(F.lit("x")).alias("none"), dates.thai_date(F.lit("5 ก.ย. 2569 เวลา 09:00")).alias("d"), dates.thai_date(F.lit("31 ก.พ. 2569")).alias("bad"),
        dates.time_range(F.lit("at 13:00 - 15:05")).alias("r"), dates.term(F.lit("3/66")).alias("t"), dates.thai_text(F.lit("2026-09-05").cast("date")).alias("text"), dates.entry_year(F.lit("1164104")).alias("entry"), dates.midpoint(F.lit(540), F.lit(635)).alias("mid"),
        dates.schedule(F.lit("จ. 09:00-12:00, FRI 13.00 – 16.30; xx 1:00-2:00\nno")).alias("s"),
    ).first()
    assert (row["thu"], row["none"], str(row["d"]), row["bad"], tuple(row["r"]), row["t"], row["text"], row["entry"], row["mid"]) == (3, None, "2026-09-05", None, (780, 905), "3/2566", "5 กันยายน 2569", 2516, 570)
    assert [tuple(m) for m in row["s"]] == [(0, 540, 720), (4, 780, 990)]


def test_keys(spark):
    for key in (b"short", b"k" * 100):
        assert one(spark, hashing.hmac_sha256(F.lit("id 1"), key)) == hmac.new(key, b"id 1", hashlib.sha256).hexdigest()
    a, b = (one(spark, hashing.cache_key("p", dict(order))) for order in ([("a", F.lit(1)), ("b", F.lit("x"))], [("b", F.lit("x")), ("a", F.lit(1))]))
    assert a == b and a.startswith("p:") and len(a) == 66
    assert [one(spark, hashing.clamped(F.lit(v), 9, 1, 22)) for v in ("30", "0", "12", "x", None)] == [22, 1, 12, 9, 9]


def test_scrubbing_at_any_depth(spark):
    raw = json.dumps({"Token": "x", "a": [{"b": "mail a.b@c.org", "PASSWORD": 1}, 5, None], "c": "0812345678 and 1164104412345"})
    assert json.loads(one(spark, X.scrub_json(F.lit(raw)))) == {"a": [{"b": "mail [EMAIL]"}, 5, None], "c": "[PHONE] and [STUDENT_ID]"}
    assert one(spark, X.scrub_json(F.lit("no json"))) is None and one(spark, X.scrub_json(F.lit("[" * 200_000))) is None
    assert one(spark, X.scrub_json(F.lit('"a@b.co"'))) == '"[EMAIL]"' and one(spark, X.scrub_json(F.lit('[[{"x": {"Cookie": {}, "y": ["a@b.co"]}}], 1.5]'))) == '[[{"x": {"y": ["[EMAIL]"]}}], 1.5]'
    assert one(spark, X.scrub(F.lit("Bearer abc.def== eyJa.eyJb.c 123456789012-3"))) == "Bearer [REDACTED] [JWT] [STUDENT_ID]"


def soft_plain(text, size, overlap):
    """The rule by itself: of all places where a chunk may end, those of lines first, then of blanks, the last one."""
    text, at, out = text.strip(), 0, []
    while at < len(text):
        places = range(at + size // 2, at + size)
        end = len(text) if at + size >= len(text) else next((p for sign in "\n " for p in reversed(places) if text[p] == sign), at + size)
        out.append(text[at:end].strip())
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return [c for c in out if c]


def lines_plain(text, size, overlap):
    """Groups of lines that can't take one more; longer lines in windows."""
    groups = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(line) <= size and groups and groups[-1] is not None and len(groups[-1]) + 1 + len(line) <= size:
            groups[-1] += "\n" + line
        elif len(line) <= size:
            groups.append(line)
        else:
            windows = [line[i : i + size] for i in range(0, len(line), size - overlap)]
            groups += [w for i, w in enumerate(windows) if (i == 0 or i * (size - overlap) < len(line) - size + (size - overlap)) and w.strip()] + [None]
    return [g for g in groups if g is not None]


def test_chunks(spark):
    cut = lambda f, text, *a: one(spark, f(F.lit(text), *a))
    assert cut(chunking.soft, "  short ", 20, 5) == ["short"] and cut(chunking.soft, " ", 20, 5) == [] and cut(chunking.soft, None, 20, 5) is None
    assert cut(chunking.soft, "aaaa bbbb\ncccc dddd eeee ffff", 14, 3) == ["aaaa bbbb", "bbb\ncccc dddd", "ddd eeee ffff"]
    xs = cut(chunking.soft, "x" * 1000, 50, 10)
    assert all(len(c) <= 50 for c in xs) and "".join(c[:40] for c in xs) == "x" * 960 + "x" * 40
    assert cut(chunking.whole_lines, "ab\n\ncd\n" + "e" * 25 + "\nf", 10, 2) == ["ab\ncd", "e" * 10, "e" * 10, "e" * 9, "f"]
    assert cut(chunking.whole_lines, "e" * 10 + "\nab", 10, 2) == ["e" * 10, "ab"] and cut(chunking.whole_lines, None, 10, 2) is None


def test_chunks_of_random_texts(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choices("ab \n\u00a0\U0001f600é", weights=[9, 9, dice.choice([1, 6]), dice.choice([0, 3]), 1, 1, 1], k=dice.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for size, overlap in ((20, 5), (9, 0), (10, 5), (12, 8), (8, 7), (2, 1), (1, 0)):
        got = {r["i"]: (r["s"], r["w"]) for r in df.select("i", chunking.soft(F.col("t"), size, overlap).alias("s"), chunking.whole_lines(F.col("t"), size, overlap).alias("w")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (soft_plain(t, size, overlap), lines_plain(t, size, overlap)), (size, overlap, t)


def test_chunks_of_a_long_text(spark):
    text = ("word " * 9 + "\n") * 40_000
    assert one(spark, F.size(chunking.soft(F.lit(text), 420, 80))) == len(soft_plain(text, 420, 80))
    with pytest.raises(ValueError, match="part"):
        chunking.chunked(spark.createDataFrame([("a", 1)], "t string, part int"), "t", 5, 1)


def test_chunk_queries_cover_texts(spark):
    df = spark.createDataFrame([(1, "one two three " * 80, "c"), (2, None, "c"), (3, " \n", "c"), (4, "word " * 10, "c")], "doc_id long, text string, part string").drop("part")
    rows = chunking.chunked(df, "text", 100, 20).collect()
    by = {i: [r["chunk"] for r in sorted(rows, key=lambda r: r["part"]) if r["doc_id"] == i] for i in (1, 2, 3, 4)}
    assert by[2] == by[3] == [] and len(by[4]) == 1 and all(len(c) <= 100 for c in by[1]) and by[1] == soft_plain("one two three " * 80, 100, 20)


def test_markdown(spark, tmp_path):
    (tmp_path / "rules.md").write_text('---\ntitle: "The rules"\ndoc_type: rule\neffective_year: 2566\nprogram_ids: ["CPE-2566", "ALL"]\n---\nlead\n# One\na\n## Two\nb\n# Three\n## Four\nc\n')
    (tmp_path / "plain.md").write_text("no headings here")
    (tmp_path / "skip.txt").write_text("# no")
    rows = {r["doc_id"]: r for r in markdown.read_documents(spark, str(tmp_path), 100, 10).collect()}
    assert sorted(rows) == ["plain#intro#0", "rules#One > Two#0", "rules#One#0", "rules#Three > Four#0", "rules#intro#0"]
    r = rows["rules#One > Two#0"]
    assert (r["title"], r["doc_type"], r["effective_year"], r["program_ids"], r["text"]) == ("The rules", "rule", 2566, ["CPE-2566", "ALL"], "b")
    assert (rows["plain#intro#0"]["title"], rows["plain#intro#0"]["program_ids"], rows["plain#intro#0"]["doc_type"]) == ("plain", [], "unknown")
    assert one(spark, markdown.text_list(F.lit("[a, 'b']"))) == ["a", "b"]


SECTIONS = [
    {"id": "A-1", "course_code": "A", "section": "1", "name_th": "ก", "name_en": "Maths", "credits": 3, "meetings": [{"day": 0, "start_min": 480, "end_min": 600}], "exams": [{"exam_type": "midterm", "exam_date": "x", "start_min": 1, "end_min": 2}, {"exam_type": "final", "exam_date": "y", "start_min": 1, "end_min": 2}], "seat_total": 10, "seat_taken": 12, "teachers": ["Ann", "Bob"], "is_online": False},
    {"id": "B-1", "course_code": "B", "section": "1", "name_en": "Physics", "meetings": [], "exams": [], "teachers": []},
    {"id": "C-1", "course_code": "C", "section": "1", "name_en": "Art", "meetings": [{"day": 7, "start_min": 1, "end_min": 2}], "exams": []},
    {"id": "D-1", "course_code": "D", "section": "1", "name_en": "Sport", "meetings": [{"day": 2, "start_min": 600, "end_min": 600}], "exams": []},
    {"id": "E-1", "course_code": "E", "section": "1", "name_en": "Web", "meetings": [], "exams": [{"exam_type": "final", "exam_date": "x", "start_min": 5, "end_min": 5}], "is_online": True},
]


def test_timetables(spark, tmp_path):
    for name, term, sections in (("cpe_timetable_1.json", "1/2569", SECTIONS[:1]), ("cpe_timetable_2.json", "1/2569", SECTIONS), ("cpe_timetable_3.json", "2/2569", SECTIONS[:2]), ("other.json", "3/2569", SECTIONS)):
        (tmp_path / name).write_text(json.dumps({"term": term, "sections": sections}))
    t = timetable.read_timetables(spark, str(tmp_path))
    assert [r["term"] for r in timetable.terms(t).collect()] == ["1/2569", "2/2569"]
    assert [timetable.of_term(t, *x).count() for x in (("1/2569",), ("9/9999",), (None, "2/2569"), (None,))] == [5, 0, 2, 5]
    assert timetable.safe_term(t, "1/2569") and not timetable.safe_term(t, "../x") and not timetable.safe_term(t, "3/2569")
    good, bad = timetable.validated(timetable.of_term(t, "1/2569"))
    assert [r["id"] for r in good.collect()] == ["A-1"] and {r["id"]: r["fault"] for r in bad.collect()} == {"B-1": "no meetings", "C-1": "bad day", "D-1": "meeting ends before it starts", "E-1": "exam ends before it starts"}
    r = timetable.for_clients(good).first()
    assert (r["seats_available"], r["teacher"], r["exam"]["exam_date"], r["meetings"][0]["day_of_week"]) == (0, "Ann, Bob", "y", 0)
    first = timetable.of_term(t, "1/2569")
    found = lambda **k: sorted(r["course_code"] for r in timetable.search(first, **k).collect())
    assert found(codes=[" a "], q="phys") == ["A"] and found(q="PHYS") == ["B"] and found(day=2) == ["D"] and found(teacher="bo") == ["A"] and found(q="%") == []
    points = {r["id"]: r["score"] for r in timetable.score(first, True, [2], [0], ["Bob"]).collect()}
    assert round(points["A-1"], 6) == round(2 * -0.2 - 4 + 1.5 + 3, 6) and points["D-1"] == -8.0 and points["E-1"] == 0.0


PAGE = "<html><head><meta charset='windows-874'></head><body>ปีการศึกษา 2569 / 1<table><tr><td>04000201-62</td><td>ฟิสิกส์ <b>1</b></td><td>3 (2-2-5)</td><td>1</td><td>36</td><td>35</td><td>1</td><td>W</td><td>x</td></tr><tr><td>short</td></tr><tr><td>nothing</td><td/><td/><td/><td/><td/><td/><td/></tr></table></body></html>"


def test_registrar_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(PAGE.encode("cp874"))
    pages = registrar.read_pages(spark, str(tmp_path))
    r = registrar.search_results(pages, "file", "html").collect()
    assert len(r) == 1 and (r[0]["course_code"], r[0]["curriculum_year"], r[0]["name_th"], tuple(r[0]["credit"]), r[0]["section"], r[0]["seat_total"], r[0]["seat_left"], r[0]["status"], r[0]["level"], r[0]["term"]) == ("04000201-62", 62, "ฟิสิกส์ 1", (3, 2, 2, 5), "1", 36, 1, "W", "x", "1/2569")
    assert registrar.decoded("ก".encode()) == "ก" and registrar.decoded("ก".encode("cp874")) == "ก"
    e = one(spark, registrar.exam(F.lit("5 ก.ย. 2569  เวลา 09:00 - 12:00 อาคาร N1 ห้อง 204")))
    assert (str(e["exam_date"]), e["start_min"], e["end_min"], e["building"], e["room"]) == ("2026-09-05", 540, 720, "N1", "204")
    block = F.lit("อาจารย์: Ann  B หมายเหตุ: late")
    assert one(spark, registrar.labelled(block, "อาจารย์")) == "Ann B" and one(spark, registrar.labelled(block, "สอบกลางภาค")) == ""


def test_transcripts(spark):
    sheets = ['รหัสวิชา,ชื่อวิชา,หน่วยกิต,เกรด\nA1,"x, y",3(2-2-5),B+\n\n,,,\n', "A1,A\nB2,F", None, " \n", "A1", "Term,Grade,Code,Code\n1/66,A,no,C3\nx,B\n", 'code,name\nD4,"two\nlines"\nCode,again\n', "code,credits\nE5,๑๒\nF6,99999999999\nG7,none", "code,name\nH8," + "z" * 200_000]
    df = spark.createDataFrame(list(enumerate(sheets)), "id int, t string")
    got = {}
    for r in sorted(transcript.from_csv_text(df, "t").collect()):
        got.setdefault(r["id"], []).append(r[2:])
    assert got == {
        0: [("A1", "x, y", 3, "B+", "")],
        1: [("A1", "", 3, "A", ""), ("B2", "", 3, "F", "")],
        4: [("A1", "", 3, "", "")],
        5: [("C3", "", 3, "A", "1/66")],
        6: [("D4", "two\nlines", 3, "", "")],
        7: [("E5", "", 12, "", ""), ("F6", "", 3, "", ""), ("G7", "", 3, "", "")],
        8: [("H8", "z" * 200_000, 3, "", "")],
    }
    assert transcript.from_csv_text(df.limit(0), "t").count() == 0
    df = spark.createDataFrame([(1, "04000201-62 Physics 1 B+ 1/2566\n\n04000202-62 เคมี 12 ไม่ผ่าน\nno grade here 99")], "id long, t string")
    assert [(r["code"], r["credits"], r["grade"]) for r in transcript.from_free_text(df, "t").orderBy("line").collect()] == [("04000201-62", 1, "B+"), ("04000202-62", 12, "ไม่ผ่าน")]


def test_event_streams(spark):
    text = ": ping\n\nevent: token\ndata: {\"a\":\ndata: 1}\n\ndata: [1]\n\nid: 4\nevent: x\ndata: {\"b\": 2}\r\n\r\ndata: {bad\n\nevent: done\ndata: {}"
    rows = sse.parse(spark.createDataFrame([(1, text)], "id long, s string"), "s").orderBy("position").collect()
    assert [(r["event"], json.loads(r["data"])) for r in rows] == [("token", {"a": 1}), ("x", {"b": 2}), ("done", {})]
    parts = spark.createDataFrame([(1, 0, "a", 0, False), (1, 1, "b", 5, True), (2, 0, "c", 0, False), (2, 1, "d", 50, False), (3, 0, "e", 0, False)], "s long, n long, t string, at long, final boolean").withColumn("at", F.timestamp_seconds("at"))
    got = {r["s"]: (r["message"], r["status"]) for r in streaming.transcript(parts, "s", "n", "t", "at", 30).collect()}
    assert got == {1: ("ab", "complete"), 2: ("cd", "interrupted"), 3: ("e", "cancelled")}
    assert streaming.split_batch(parts, 5)[1] and not streaming.split_batch(parts, 4)[1]


def test_version_history(spark):
    lines = spark.createDataFrame([("abcdef0123|Ann|2024-01-01|a | b",), ("abcdef0123|Ann|2024-01-01|ok",), ("bad|line",)], "value string")
    assert [(r["sha"], r["subject"]) for r in commits.commit_lines(lines, "|").collect()] == [("abcdef0", "ok")]
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate(["1\t1\tlost", "@|Ann", "3\t4\tweb/a", "", "-\t-\tapi/b", "@|Bob", "1\t0\tx"])], "log long, n long, value string")
    got = commits.changed_lines(log, "log", "n", "|").withColumn("module", commits.module_of(F.col("path"), ["web", "api"])).collect()
    assert sorted((r["author"], r["added"], r["path"], r["module"]) for r in got if r["added"]) == [("Ann", 3, "web/a", "web"), ("Bob", 1, "x", None)] and len(got) == 3


def test_sinks(spark):
    old, new = spark.createDataFrame([("a", 0)], "k string, n long"), spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5)], "k string, n long")
    assert sorted(r["n"] for r in sinks.insert_new(old, new, "k", ["n"]).collect()) == [2, 4, 5]
    left, gone = sinks.delete_of({"x": new, "y": old}, "k", spark.createDataFrame([("b",)], "k string"))
    assert left["x"].count() == 3 and {r["name"]: r["deleted"] for r in gone.collect()} == {"x": 2, "y": 0}
    assert {r["k"]: r["n"] for r in sinks.last_write(new.filter("k is not null"), "k", ["n"]).collect()} == {"a": 1, "b": 3}
    assert [tuple(r) for r in sinks.with_positions(spark.createDataFrame([(1, ["x", "y"])], "p long, i array<string>"), "p", "i").collect()] == [(1, 0, "x"), (1, 1, "y")]


def test_graph_reports(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (2, 1), (5, 1)], "a long, b long")
    assert sorted(r["cycle"] for r in graph.cycles(df).collect()) == [[1, 2], [1, 2, 3], [4]]
    r = {x["node"]: (x["before"], x["after"]) for x in graph.neighbours(df).collect()}
    assert r[1] == ([2, 3, 5], [2]) and r[5] == ([], [1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    assert graph.reach(chain).agg(F.max("depth"), F.count("*")).first()[:] == (70, 70 * 71 // 2)
    with pytest.raises(ValueError):
        graph.reach(df)


def test_questions(spark):
    v = lambda t: one(spark, questions.variants(F.lit(t), ["what is {}", "{} how"], ["please", "the"]))
    assert v("RSI!") == ["rsi", "what is rsi", "rsi how"] and v("please tell me about the RSI") == ["please tell me about the rsi", "tell me about rsi"]


def test_lanes(spark):
    """Against a plain assignment of the first free lane."""
    import random

    from termloom.operators import intervals

    draw = random.Random(5)
    rows = [(k, i, s := draw.randrange(60), s + draw.randrange(1, 12)) for k in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "k long, i long, s long, e long")
    got = {(r["k"], r["i"]): (r["lane"], r["n_lanes"]) for r in intervals.lanes(intervals.lanes_groups(df, ["k"], "s", "e", ["i"]), ["k", "lane_group"], "s", "e", ["i"]).collect()}
    want = {}
    for k in range(4):
        ends, members = [], []
        for s, i, e in [*sorted((s, i, e) for kk, i, s, e in rows if kk == k), (10**6, None, 0)]:
            if members and s >= max(ends):  # all have ended: a new group
                want |= {(k, j): (lane, len(ends)) for j, lane in members}
                ends, members = [], []
            lane = next((n for n, x in enumerate(ends) if x <= s), len(ends))
            ends[lane : lane + 1] = [e]
            members.append((i, lane))
    assert got == want


def test_relaxation(spark):
    pool = spark.createDataFrame([("a", 1, 3.0, 1, "x", True), ("b", 1, 3.0, 1, "y", False), ("c", 1, 0.5, 1, "z", False)], "who string, rank int, cost double, mask long, item string, nice boolean")
    got = {r["who"]: (r["status"], r["chosen"]) for r in planning.relaxed(pool, "who", ["rank"], "cost", "mask", "item", 6.0, 2.0, [("strict", "nice", True), ("any", "true", True)]).collect()}
    assert got == {"a": ("strict", "x"), "b": ("any", "y"), "c": ("infeasible", None)}


def test_queries_without_sql_on_tables(spark):
    """greedy plans and chunks against plain Python on the small tables."""
    from termloom import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, cut in (("doc_chunks_soft", soft_plain), ("doc_chunks_lines", lines_plain)):
        got = {r["doc_id"]: (r["n"], r["digest"]) for r in queries.queries()[name](spark, sf).collect()}
        assert got == {i: (len(c), hashlib.md5("\f".join(c).encode()).hexdigest()) for i, t in texts.items() if (c := cut(t or "", 420, 80))}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).collect()
    want = {}
    for r in sorted(lines, key=lambda r: (r["o_custkey"], -r["l_discount"], r["l_orderkey"], r["l_linenumber"], r["l_partkey"])):
        cost, mask, items = want.get(r["o_custkey"], (0.0, 0, []))
        bit = 1 << r["l_partkey"] % 26
        if cost + r["l_quantity"] <= 60 and not mask & bit:
            want[r["o_custkey"]] = (cost + r["l_quantity"], mask | bit, [*items, f"{r['l_orderkey']}-{r['l_linenumber']}"])
    got = {r["o_custkey"]: (r["cost"], r["chosen"]) for r in queries.queries()["greedy_plan"](spark, sf).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {k: (round(c, 2), ",".join(i)) for k, (c, _, i) in want.items()}
    users = {r["event_id"]: r["user_id"] for r in spark.read.parquet(f"{sf}/events.parquet").filter("user_id is not null").collect()}
    assert all(r["user"] == hmac.new(b"key of the tests", str(users[r["event_id"]]).encode(), hashlib.sha256).hexdigest()[:16] for r in queries.queries()["masked_users"](spark, sf).collect())
    assert {r["status"] for r in queries.queries()["relaxed_plan"](spark, sf).collect()} <= {"strict", "no_preferences", "full_allowed", "no_minimum", "infeasible"}
