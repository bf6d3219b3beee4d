"""Saved pages of a registrar: search results as rows, exams and labelled values from text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import dates
from termloom.functions import text as X

CODE = r"\b(\d{8})-(\d{2})\b"
#: The labels of a section's rows; a value ends where the next label begins.
LABELS = ("อาจารย์", "สำรอง สำหรับ", "สำรองสำหรับ", "สอบกลาง ภาค", "สอบกลางภาค", "สอบปลาย ภาค", "สอบปลายภาค", "หมายเหตุ")
#: Names of Thai code pages that Python knows by another name.
THAI_PAGES = {"windows-874": "cp874", "tis-620": "cp874", "iso-8859-11": "cp874"}


def decoded(raw: bytes) -> str:
    """By the charset that the page names near its beginning, else UTF-8, else the Thai code page."""
    named = re.search(r"charset=[\"']?\s*([\w-]+)", raw[:4096].decode("ascii", errors="ignore").lower())
    for encoding in ([THAI_PAGES.get(named[1], named[1])] if named else []) + ["utf-8"]:
        try:
            return raw.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("cp874", errors="replace")


class _Rows(HTMLParser):
    """Rows of a page's tables as lists of their own cells' texts; tables inside cells are rows of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open: list[list[list[str]]] = []
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.open.append([])
        elif tag == "td" and self.open:
            self.open[-1].append([])

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr" and self.open:
            self.rows.append([" ".join(" ".join(cell).split()) for cell in self.open.pop()])

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        for row in self.open:
            if row:
                row[-1].append(data)


def read_pages(spark: SparkSession, path: str, files: str = "*.html") -> DataFrame:
    """file and html of saved pages, decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoded(b) for b in batch.column(1).to_pylist()], pa.string())], names=["file", "html"])

    return spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "content").mapInArrow(run, "file string, html string")


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, position, cells and the whole page's text of every table row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for i, page in enumerate(part.column(1).to_pylist()):
                    parser = _Rows()
                    parser.feed(page or "")
                    parser.close()
                    text = " ".join(" ".join(parser.text).split())
                    out += [(i, k, cells, text) for k, cells in enumerate(parser.rows)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.string())), pa.array([o[3] for o in out], pa.string())], names=[key, "position", "cells", "page"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, position int, cells array<string>, page string")


def search_results(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row a section: rows of eight cells or more whose first holds a course code; the term is that of the page."""
    rows = table_rows(pages, key, html).filter((F.size("cells") >= 8) & F.get("cells", F.lit(0)).rlike(CODE))
    cell = lambda i: F.get("cells", F.lit(i))
    year = F.regexp_extract("page", r"(\d{4})\s*/\s*(\d)|(\d)\s*/\s*(\d{4})", 0)
    term = F.when(year.rlike(r"^\d{4}"), F.concat(F.right(year, F.lit(1)), F.lit("/"), F.left(year, F.lit(4)))).when(year != "", F.concat(F.left(year, F.lit(1)), F.lit("/"), F.right(year, F.lit(4))))
    return rows.select(key, "position", F.regexp_extract(cell(0), CODE, 0).alias("course_code"), F.regexp_extract(cell(0), CODE, 2).cast("int").alias("curriculum_year"), cell(1).alias("name_th"), X.credits(cell(2)).alias("credit"), cell(3).alias("section"), *(cell(i).try_cast("int").alias(c) for i, c in ((4, "seat_total"), (5, "seat_taken"), (6, "seat_left"))), cell(7).alias("status"), F.coalesce(cell(8), F.lit("")).alias("level"), term.alias("term"))


def exam(text: Column) -> Column:
    """Date, time range, building and room of a text such as ``5 ก.ย. 2569 เวลา 09:00 - 12:00 อาคาร A ห้อง 1``."""
    own = X.clean(text)
    span = dates.time_range(own)
    return F.struct(dates.thai_date(own).alias("exam_date"), span["start_min"].alias("start_min"), span["end_min"].alias("end_min"), F.regexp_extract(own, r"อาคาร\s*(\S+)", 1).alias("building"), F.regexp_extract(own, r"ห้อง\s*(\S+)", 1).alias("room"))


def labelled(text: Column, label: str) -> Column:
    """What stands after a label, up to the next of LABELS; empty where the label does not stand."""
    after = F.when(F.contains(text, F.lit(label)), F.substr(text, F.locate(label, text) + len(label))).otherwise("")
    for other in LABELS:
        if other != label:
            after = F.substring_index(after, other, 1)
    return F.trim(F.regexp_replace(X.clean(after), "^:+", ""))
