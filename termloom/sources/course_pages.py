"""Saved pages of a registrar whose rows depend on the rows before: course details and degree audits as nested tables.

Tasks only turn a page into its table rows. What kind a row is, which heading it stands under and what is collected from it
are column expressions and running windows over a page's rows, so one shuffle of narrow rows serves a whole table of pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import dates
from termloom.functions import text as X
from termloom.sources.registrar import CODE, exam, labelled

#: How levels, seats (total, taken, left), states of a section and kinds of meeting are written.
LEVEL, SEATS = r"ระดับ *\d+ *: *.+", r"\b(\d{1,3}) (\d{1,3}) (\d{1,3})\b"
STATES, KINDS = ("W", "R", "C"), ("C", "L")
#: Rows with details of a section hold one of these; a level's row is shorter than this.
DETAILS, LEVEL_CHARS = ("อาจารย์", "สอบกลาง", "สอบปลาย", "หมายเหตุ"), 80
#: Course codes, terms and category headings of an audit, and grades that pass.
AUDIT_CODE, AUDIT_TERM, CATEGORY = r"^(\d{8}-\d{2}|C\d{7}|\d{8}|\d{2}-\d{3}-\d{3})$", r"^\d/\d{2}$", r"^(\d+(?:\.\d+)*) (.+)$"
NUMBER = r"-?\d+(?:\.\d+)?"
PASSING = ("A", "B+", "B", "C+", "C", "D+", "D", "S", "ผ่าน", "P")
#: Fixed value: an audit shows this many columns of terms and of grades, where it shows all.
AUDIT_COLUMNS = 10
#: Tags without attributes, and those whose contents are no markup.
TAG, RAW = re.compile(r"<(/?[a-z][a-z0-9]*)>"), {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


class _Row:
    def __init__(self) -> None:
        self.cells: list[list[str]] = []
        self.text: list[str] = []
        self.boxes: list[bool] = []
        self.cell: list[str] | None = None


class _Page(HTMLParser):
    """Rows of all tables in the order in which they begin; a row knows the texts of its own cells and its whole text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[_Row] = []
        self.text: list[str] = []
        self.open: list[_Row | None] = []  # the row that is open in each open table
        self.hidden = False

    def read(self, html: str) -> None:
        """The whole page. One of plain tags only is cut at them, which is what the parser would do more slowly."""
        parts = TAG.split(html)
        if "&" in html or html.count("<") != len(parts) // 2 or not RAW.isdisjoint(parts[1::2]):
            self.feed(html)
            self.close()
            return
        for i, part in enumerate(parts):
            if i % 2 and part[0] == "/":
                self.handle_endtag(part[1:])
            elif i % 2:
                self.handle_starttag(part, [])
            elif part:
                self.handle_data(part)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        now = self.open[-1] if self.open else None
        if tag == "table":
            self.open.append(None)
        elif tag == "tr":  # also ends a row without an end tag
            self.rows.append(_Row())
            self.open[-1:] = [self.rows[-1]]
        elif tag == "td" and now:
            now.cell = []
            now.cells.append(now.cell)
        elif tag == "th" and now:
            now.cell = None
        elif tag == "input" and (dict(attrs).get("type") or "").lower() == "checkbox":
            for row in filter(None, self.open):
                row.boxes.append("checked" in dict(attrs))
        elif tag in ("script", "style"):
            self.hidden = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = False
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag == "tr" and self.open:
            self.open[-1] = None
        elif tag == "td" and self.open and self.open[-1]:
            self.open[-1].cell = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.text.append(data)
        for row in filter(None, self.open):
            row.text.append(data)
            if row.cell is not None:
                row.cell.append(data)


def _joined(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def page_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, page (a number of its own, as keys may repeat), text and rows (position, cells, text, boxes) of every page.

    A null or empty page has no rows. Boxes are a row's check boxes, true where they are ticked.
    """
    row = pa.struct([("position", pa.int32()), ("cells", pa.list_(pa.string())), ("text", pa.string()), ("boxes", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, texts, rows, ends = batch.slice(at, 64), [], [], [0]
                for html_text in part.column(1).to_pylist():
                    parser = _Page()
                    parser.read(html_text or "")
                    texts.append(_joined(parser.text))
                    rows += parser.rows
                    ends.append(len(rows))
                places = [k for a, b in zip(ends, ends[1:]) for k in range(b - a)]
                columns = [pa.array(places, pa.int32()), pa.array([[_joined(c) for c in r.cells] for r in rows], row.field("cells").type), pa.array([_joined(r.text) for r in rows], pa.string()), pa.array([r.boxes for r in rows], row.field("boxes").type)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(row)))], names=["key", "text", "rows"])

    kind = pages.schema[key].dataType.simpleString()
    read = pages.select(key, html).mapInArrow(run, f"key {kind}, text string, rows array<struct<position:int,cells:array<string>,text:string,boxes:array<boolean>>>")
    return read.withColumn("page", F.monotonically_increasing_id())


def _from(cells: Column, start: Column | int) -> Column:
    """Cells from a place on, counted from 1."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.slice(cells, start.cast("int"), F.greatest(F.size(cells), F.lit(1)))


def _at(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i))


def _earliest(value: Column, present: Column) -> Column:
    """Of a group's rows the first value, in order of position, that is there."""
    return F.min(F.when(present, F.struct("position", value.alias("v"))))["v"]


def _latest(value: Column, present: Column) -> Column:
    return F.max(F.when(present, F.struct("position", value.alias("v"))))["v"]


def _in_order(value: Column, present: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.when(present, F.struct("position", value.alias("v"))))), lambda x: x["v"])


def _carried() -> Window:
    return Window.partitionBy("page").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _course(text: Column) -> Column:
    words = F.split(F.trim(F.substring_index(F.regexp_extract(text, CODE + "(.*)", 3), "สังกัด", 1)), " ")
    thai = lambda w: w.rlike("[฀-๿]")
    year = lambda i: F.regexp_extract(text, r"เลือก\s*ปีการศึกษา\s*:?\s*(\d)\s*/\s*(\d{4})", i)
    return F.struct(
        F.regexp_extract(text, CODE, 0).alias("course_code"),
        F.array_join(F.filter(words, lambda w: ~thai(w)), " ").alias("name_en"),
        F.array_join(F.filter(words, thai), " ").alias("name_th"),
        F.substring_index(labelled(text, "สังกัด"), " หน่วยกิต", 1).alias("faculty"),
        X.credits(labelled(text, "หน่วยกิต")).alias("credit"),
        F.regexp_extract(text, r"สถานะรายวิชา\s*:?\s*(\S+)", 1).alias("status"),
        F.when(year(1) != "", F.concat(year(1), F.lit("/"), year(2))).alias("term"),
    )


def _meeting(cells: Column) -> Column:
    """Day, time, then room, building, kind and others in any number; null without a time."""
    span, rest = dates.time_range(_at(cells, 1)), _from(cells, 3)
    places = F.filter(rest, lambda c: ~c.isin(*KINDS, *STATES) & ~c.rlike(SEATS))
    part = lambda i: F.coalesce(_at(places, i), F.lit(""))
    kind = F.coalesce(_at(F.filter(rest, lambda c: c.isin(*KINDS)), 0), F.lit(""))
    return F.when(span.isNotNull(), F.struct(dates.day_number(_at(cells, 0)).alias("day"), _at(cells, 0).alias("day_text"), span["start_min"].alias("start_min"), span["end_min"].alias("end_min"), part(0).alias("room"), part(1).alias("building"), kind.alias("kind")))


def _either(text: Column, *labels: str) -> Column:
    found = [labelled(text, name) for name in labels]
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in found), F.lit(""))


def course_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each page: ``key``, the course's fields and its sections, each with level, meetings, seats, teachers and exams.

    A level's row holds for the sections after it, a section's row for the meetings and details after it. Of details that
    come more than once in a section the first counts. Pages without a course or sections have empty fields and no
    sections; repeated pages and keys stay repeated.
    """
    flat = page_rows(pages, key, html).withColumn("course", _course(F.col("text"))).select("key", "page", "course", F.explode_outer("rows").alias("r"))
    flat = flat.select("key", "page", "course", "r.position", "r.text", F.coalesce("r.cells", F.array().cast("array<string>")).alias("cells"))
    begin = F.array_position(F.transform("cells", lambda c: c != ""), True)
    flat = flat.withColumn("cells", F.when(begin > 0, _from(F.col("cells"), F.greatest(begin, F.lit(1)))).otherwise(F.array().cast("array<string>")))
    cells, text = F.col("cells"), F.col("text")
    level = F.when(F.length(text) < LEVEL_CHARS, F.nullif(F.regexp_extract(text, LEVEL, 0), F.lit("")))
    day = lambda i: dates.day_number(_at(cells, i)).isNotNull()
    told = F.greatest(*(F.contains(text, F.lit(w)) for w in DETAILS))
    kind = F.when(level.isNotNull(), "level").when(F.size(cells) == 0, "none").when(_at(cells, 0).rlike(r"^\d{1,2}$") & day(1), "section").when(day(0) & (F.size(cells) >= 2), "meeting").when(told, "details")
    rows = flat.withColumn("level", level).withColumn("kind", kind)
    is_a = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    after = F.array_join(_from(cells, 3), " ")
    seat = lambda i: F.regexp_extract(after, SEATS, i).try_cast("int")
    state = F.element_at(F.concat(F.array(F.lit("")), F.filter(cells, lambda c: c.isin(*STATES))), -1)
    head = F.struct(F.lpad(_at(cells, 0), 2, "0").alias("section"), *(seat(i).alias(c) for i, c in ((1, "seat_total"), (2, "seat_taken"), (3, "seat_left"))), state.alias("status"))
    met = _meeting(F.when(is_a("section"), _from(cells, 2)).otherwise(cells))
    people = F.filter(F.transform(F.split(labelled(text, "อาจารย์"), "[,/]"), X.clean), lambda p: p != "")
    kept = _either(text, "สำรอง สำหรับ", "สำรองสำหรับ")
    middle, last = _either(text, "สอบกลาง ภาค", "สอบกลางภาค"), _either(text, "สอบปลาย ภาค", "สอบปลายภาค")
    said = F.struct(people.alias("teachers"), kept.alias("reserved_for"), middle.alias("middle"), last.alias("last"), labelled(text, "หมายเหตุ").alias("note"))
    # what a row holds is read once, by its kind, before it moves; the course moves with the first row only
    rows = rows.select("key", "page", "position", F.when(F.coalesce("position", F.lit(0)) == 0, F.col("course")).alias("course"), "level", "kind", F.when(is_a("section"), head).alias("head"), F.when(is_a("section") | is_a("meeting"), met).alias("met"), F.when(is_a("details"), said).alias("said"))
    rows = rows.withColumn("level", F.last("level", ignorenulls=True).over(_carried())).withColumn("number", F.sum(is_a("section").cast("int")).over(_carried()))
    sections = rows.groupBy("page", "number").agg(F.first("key").alias("key"), F.first("course", ignorenulls=True).alias("course"), F.sort_array(F.collect_list(F.struct("position", "level", "head", "met", "said"))).alias("rows"))
    first = lambda present: F.get(F.filter("rows", present), F.lit(0))
    told = lambda name: F.coalesce(first(lambda r: r["said"][name] != "")["said"][name], F.lit("")).alias(name)
    meetings = F.transform(F.filter("rows", lambda r: r["met"].isNotNull()), lambda r: r["met"])
    teachers = F.coalesce(first(lambda r: F.size(r["said"]["teachers"]) > 0)["said"]["teachers"], F.array().cast("array<string>"))
    sections = sections.select("page", "number", "key", "course", first(lambda r: r["head"].isNotNull()).alias("top"), meetings.alias("meetings"), teachers.alias("teachers"), *map(told, ("reserved_for", "middle", "last", "note")))
    held = lambda name, label: F.when(F.col(name) != "", exam(F.col(name))).alias(label)
    own = F.struct("top.head.section", F.coalesce("top.level", F.lit("")).alias("level"), "meetings", *(f"top.head.{c}" for c in ("seat_total", "seat_taken", "seat_left", "status")), "teachers", "reserved_for", held("middle", "midterm"), held("last", "final"), "note")
    sections = sections.select("page", "key", "course", F.when(F.col("number") > 0, F.struct("number", own.alias("own"))).alias("section"))
    whole = sections.groupBy("page").agg(F.first("key").alias("key"), F.first("course", ignorenulls=True).alias("course"), F.sort_array(F.collect_list("section")).alias("sections"))
    return whole.select(F.col("key").alias(key), "course.*", F.transform("sections", lambda s: s["own"]).alias("sections"))


def _after(text: Column, label: str, kind: str) -> Column:
    """The number behind a label; null for ``-`` and where there is none."""
    return F.regexp_extract(text, f"{label}\\s*:?\\s*({NUMBER}|-)", 1).try_cast("double").cast(kind)


def _ticked() -> Column:
    """Whether the first of a row's two boxes is ticked (true), the second (false), or neither (null)."""
    boxes, text = F.col("boxes"), F.col("text")
    drawn = F.when(F.contains(text, F.lit("☑ ผ่าน")) | F.contains(F.lower(text), F.lit("[x] ผ่าน")), True).when(F.contains(text, F.lit("☑ ไม่ผ่าน")), False)
    return F.when(F.size(boxes) >= 2, F.when(F.get(boxes, F.lit(0)), True).when(F.get(boxes, F.lit(1)), False)).otherwise(drawn)


def _taken(cells: Column) -> Column:
    """A course's row: code, name, credits, terms, as many grades, and two numbers that may be missing."""
    credit = F.coalesce(_at(cells, 2), F.lit(""))
    rest, pair = _from(cells, 4), F.slice(cells, -2, 2)
    numbers = (F.size(rest) >= 2) & F.forall(pair, lambda c: c.rlike(f"^{NUMBER}$"))
    rest = F.when(numbers, F.slice(rest, 1, F.greatest(F.size(rest) - 2, F.lit(0)))).otherwise(rest)
    terms = F.filter(rest, lambda c: c.rlike(AUDIT_TERM))
    zone = _from(rest, 1 + F.when(F.size(rest) >= AUDIT_COLUMNS, F.floor(F.size(rest) / 2)).otherwise(F.size(terms)))
    grades = F.filter(zone, lambda c: (c != "") & ~c.rlike(AUDIT_TERM) & ~c.rlike(f"^{NUMBER}$"))
    tries = F.transform(terms, lambda t, i: F.struct(dates.term(t).alias("term"), F.coalesce(F.get(grades, i), F.lit("")).alias("grade")))
    number = lambda i: F.when(numbers, _at(pair, i).try_cast("double"))
    points = F.regexp_extract(credit, r"(\d+)\s*\(\s*\d+-\d+-\d+\s*\)|^(\d+)$", 0)
    return F.struct(_at(cells, 0).alias("code"), F.coalesce(_at(cells, 1), F.lit("")).alias("name"), F.coalesce(F.regexp_extract(points, r"^\d+", 0).try_cast("int"), F.lit(0)).alias("credits"), tries.alias("attempts"), number(0).alias("average"), number(1).alias("final"), F.exists(tries, lambda t: t["grade"].isin(*PASSING)).alias("passed"))


def degree_audits(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each page: ``key``, the student's fields, totals, and categories with their courses.

    A heading holds for the courses and the total after it; the first total is that of the whole degree, and of several
    totals of a category the last counts. earned is the stated total, else the sum of the top categories' stated totals,
    else the credits of passed courses; remaining is what is missing to the required total (null where none is
    required). Courses before any category are left out. Pages without an audit have null fields and no categories.
    """
    whole = F.col("text")
    who = r"(\d{12}-\d)\s+(.+?)\s+ตรวจสอบจบ"
    student = F.struct(F.regexp_extract(whole, who, 1).alias("student_id"), F.regexp_extract(whole, who, 2).alias("student_name"), _after(whole, "จำนวนหน่วยกิตขั้นต่ำ", "int").alias("min_total_credits"), _after(whole, "ปีสูงสุด", "int").alias("max_years"), _after(whole, "GPAX ต่ำสุด", "double").alias("min_gpax"))
    none = F.array().cast("array<string>")
    flat = page_rows(pages, key, html).withColumn("student", student).select("key", "page", "student", F.explode_outer("rows").alias("r"))
    flat = flat.select("key", "page", "student", "r.position", "r.text", "r.boxes", F.coalesce("r.cells", none).alias("all"))
    flat = flat.withColumn("cells", F.filter("all", lambda c: c != "")).withColumn("line", F.array_join("cells", " "))
    first, line = F.coalesce(_at(F.col("cells"), 0), F.lit("")), F.col("line")
    heading = F.contains(line, F.lit("หน่วยกิตต่ำสุด")) & ~F.contains(first, F.lit("รวม"))
    kind = F.when(heading, F.when(first.rlike(CATEGORY), "category")).when(first.startswith("รวม") & F.contains(line, F.lit("หน่วยกิตที่ผ่าน")), "total").when(first.rlike(AUDIT_CODE), "course")
    rows = flat.withColumn("kind", kind)
    is_a = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    rows = rows.withColumn("number", F.sum(is_a("category").cast("int")).over(_carried())).withColumn("totals", F.sum(is_a("total").cast("int")).over(_carried()))
    grand, own = is_a("total") & (F.col("totals") == 1), is_a("total") & (F.col("totals") > 1)
    headed = lambda v: F.max(F.when(is_a("category"), v))
    total = F.struct(_after(line, "หน่วยกิตที่ผ่าน", "int").alias("passed_credits"), _after(line, "GPA เฉลี่ย", "double").alias("gpa"), _ticked().alias("is_passed"), F.contains(line, F.lit("ต่ำกว่าเกณฑ์")).alias("below_min"))
    name = F.trim(F.substring_index(F.regexp_extract(first, CATEGORY, 2), "หน่วยกิตต่ำสุด", 1))
    place = F.regexp_extract(first, CATEGORY, 1)
    parts = rows.groupBy("page", "number").agg(
        F.first("key").alias("key"),
        F.first("student").alias("student"),
        F.max(F.when(grand, F.struct("position", total.alias("v"))))["v"].alias("grand"),
        headed(place).alias("place"),
        headed(name).alias("name"),
        *(headed(_after(line, label, t)).alias(c) for label, t, c in (("หน่วยกิตต่ำสุด", "int", "min_credits"), ("หน่วยกิตสูงสุด", "int", "max_credits"), ("GPAX ต่ำสุด", "double", "min_gpax"))),
        _latest(total, own).alias("total"),
        _in_order(_taken(F.col("all")), is_a("course")).alias("courses"),
    )
    passed = F.aggregate(F.filter("courses", lambda c: c["passed"]), F.lit(0), lambda a, c: a + c["credits"])
    depth = F.size(F.split("place", r"\."))
    got = F.coalesce(F.col("total.passed_credits"), passed)
    category = F.struct(F.col("place").alias("number"), "name", depth.alias("depth"), F.when(depth > 1, F.regexp_replace("place", r"\.\d+$", "")).alias("parent"), "min_credits", "max_credits", "min_gpax", "total.passed_credits", "total.gpa", "total.is_passed", F.coalesce("total.below_min", F.lit(False)).alias("below_min"), F.greatest(F.col("min_credits") - got, F.when(F.col("min_credits").isNotNull(), 0)).alias("remaining_credits"), "courses")
    there = F.col("number") > 0
    out = parts.groupBy("page").agg(
        F.first("key").alias("key"),
        F.first("student").alias("student"),
        F.first("grand", ignorenulls=True).alias("grand"),
        F.sum(F.when(there & (depth == 1), F.col("total.passed_credits"))).cast("int").alias("stated"),
        F.coalesce(F.sum(F.when(there, passed)), F.lit(0)).cast("int").alias("passed"),
        F.sort_array(F.collect_list(F.when(there, F.struct("number", category.alias("own"))))).alias("categories"),
    )
    earned = F.coalesce("grand.passed_credits", "stated", "passed")
    required = F.col("student.min_total_credits")
    return out.select(F.col("key").alias(key), "student.*", F.col("grand.passed_credits").alias("total_passed_credits"), F.col("grand.gpa").alias("gpa"), earned.alias("earned_credits"), F.when(required.isNotNull(), F.greatest(required - earned, F.lit(0))).alias("remaining_credits"), F.transform("categories", lambda c: c["own"]).alias("categories"))
