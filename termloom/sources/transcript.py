"""Transcripts inside a text column: CSV with an inferred header, and free lines."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.text import stripped

#: Words by which a header's columns are known, in the order in which they are tried.
HEADER = (("code", ("code", "รหัส", "course_id")), ("name", ("name", "ชื่อวิชา", "รายวิชา", "title")), ("credits", ("credit", "หน่วยกิต", "cr")), ("grade", ("grade", "เกรด", "ระดับคะแนน")), ("term", ("term", "ภาค", "ปี", "semester")))
#: Grades of free lines, and the credits of a row that names none.
GRADES, CREDITS = r"(?i)(?<![\p{L}\p{N}_])(A|B\+|B|C\+|C|D\+|D|F|W|U|S|P|I|ผ่าน|ไม่ผ่าน|ไม่สอบ|ขาดสอบ)(?![\p{L}\p{N}_])", 3
#: Codes that only a header has, and the digits of Thai in order.
REPEATED, THAI_DIGITS = ("course_code", "รหัสวิชา", "code"), "๐๑๒๓๔๕๖๗๘๙"
FIELDS = ("code", "name", "credits", "grade", "term")


def _records(texts: pd.Series) -> pd.Series:
    """The cells of each line that has any: quotes may hold commas and line ends, which only a reader of CSV can follow."""
    csv.field_size_limit(2**31 - 1)  # a cell may be as long as a text
    return texts.map(lambda t: None if t is None else [cells for cells in csv.reader(io.StringIO(t)) if any(cells)])


def from_csv_text(texts: DataFrame, column: str) -> DataFrame:
    """The other columns, line (from 0, of those kept), and code, name, credits, grade, term of each line.

    The first line is a header if one of its titles names a code; else code and grade lead. A field's place is the last
    title that names it. Lines without a code and repeated headers go; a cell that a line lacks is empty; credits are the
    first whole number of their cell, CREDITS without one or beyond an int. Null and empty texts give no rows.
    """
    rest = [c for c in texts.columns if c != column]
    read = texts.select(*rest, F.pandas_udf(_records, T.ArrayType(T.ArrayType(T.StringType())))(stripped(F.col(column))).alias("__all"))
    read = read.filter(F.size("__all") > 0).withColumn("__first", F.col("__all")[0])

    def field_of(title: Column) -> Column:
        own = F.lower(stripped(title))
        return F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(own, w)), field) for field, words in HEADER), F.lit(""))

    read = read.withColumn("__fields", F.transform("__first", field_of))
    headed = F.array_contains("__fields", "code")
    last = {f: F.size("__fields") - F.nullif(F.array_position(F.reverse("__fields"), f), F.lit(0)) for f in FIELDS}
    bare = {"code": F.lit(0), "grade": F.when(F.size("__first") > 1, 1)}
    read = read.withColumn("__at", F.struct(*((F.when(headed, last[f]).otherwise(bare[f]) if f in bare else last[f]).cast("int").alias(f) for f in FIELDS)))
    cell = lambda cells, f: F.coalesce(stripped(F.get(cells, F.col("__at")[f])), F.lit(""))
    body = F.when(headed, F.slice("__all", F.lit(2), F.size("__all"))).otherwise(F.col("__all"))
    kept = F.filter(body, lambda cells: ~F.lower(cell(cells, "code")).isin("", *REPEATED))
    lines = read.select(*rest, "__at", F.posexplode(kept).alias("line", "__cells"))
    number = F.regexp_extract(F.translate(cell(F.col("__cells"), "credits"), THAI_DIGITS, "0123456789"), r"(\d+)", 1).try_cast("int")
    return lines.select(*rest, "line", *((F.coalesce(number, F.lit(CREDITS)) if f == "credits" else cell(F.col("__cells"), f)).alias(f) for f in FIELDS))


def from_free_text(texts: DataFrame, column: str) -> DataFrame:
    """The other columns, line, code (the first word-like run), credits (the first whole number from 1 to 12) and grade."""
    rest = [c for c in texts.columns if c != column]
    lines = texts.select(*rest, F.posexplode(F.split(F.trim(column), "\r?\n")).alias("line", "own")).withColumn("own", F.trim("own"))
    code = F.regexp_extract("own", r"([A-Za-z0-9]+(?:-[0-9]+)?)", 1)
    number = F.get(F.filter(F.split("own", r"\s+"), lambda t: t.rlike(r"^0*([1-9]|1[0-2])$") & (t != code)), F.lit(0)).cast("int")
    found = lines.select(*rest, "line", code.alias("code"), F.coalesce(number, F.lit(CREDITS)).alias("credits"), F.regexp_extract("own", GRADES, 1).alias("grade"))
    return found.filter("code <> '' and grade <> ''")
