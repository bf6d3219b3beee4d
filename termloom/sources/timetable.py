"""Timetables: one JSON file a term with nested sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how a term is written.
TERM = r"^[1-3]/25\d\d$"
MEETING = "array<struct<day: int, start_min: int, end_min: int, room: string, building: string>>"
EXAM = "array<struct<exam_type: string, exam_date: string, start_min: int, end_min: int>>"
SECTION = f"struct<id: string, course_code: string, section: string, name_th: string, name_en: string, credits: int, meetings: {MEETING}, exams: {EXAM}, seat_total: int, seat_taken: int, prerequisites: array<string>, teachers: array<string>, is_online: boolean, slots_mask: string, suggested_year: int>"


def read_timetables(spark: SparkSession, path: str, files: str = "cpe_timetable_*.json") -> DataFrame:
    """A row a section, with its term; of files of one term the last by name counts."""
    raw = spark.read.schema(f"term string, sections array<{SECTION}>").option("multiLine", True).option("pathGlobFilter", files).json(path).select("term", "sections", F.col("_metadata.file_name").alias("file"))
    last = raw.groupBy("term").agg(F.max("file").alias("file"))
    return raw.join(last, ["term", "file"]).select("term", F.posexplode("sections").alias("position", "s")).select("term", "position", "s.*")


def terms(sections: DataFrame) -> DataFrame:
    return sections.select("term").distinct().orderBy("term")


def of_term(sections: DataFrame, term: str | None, default: str | None = None) -> DataFrame:
    """The term's rows, none where it is unknown; without a term the default's, else the first term's."""
    if term is None:
        term = default or next((r["term"] for r in terms(sections).limit(1).collect()), None)
    return sections.filter(F.col("term") == F.lit(term))


def safe_term(sections: DataFrame, term: str) -> bool:
    """Whether the text is a term by form and one of the table's; nothing is read by it before."""
    import re

    return bool(re.match(TERM, term)) and not sections.filter(F.col("term") == term).isEmpty()


def faults(meetings: Column, exams: Column, online: Column) -> Column:
    """Why a section can't be used, or null: no meetings though not online, a bad day, or an end before its start."""
    backwards = lambda x: x["end_min"] <= x["start_min"]
    return (
        F.when(~F.coalesce(online, F.lit(False)) & (F.coalesce(F.size(meetings), F.lit(0)) < 1), "no meetings")
        .when(F.exists(meetings, lambda m: (m["day"] < 0) | (m["day"] > 6)), "bad day")
        .when(F.exists(meetings, backwards), "meeting ends before it starts")
        .when(F.exists(exams, backwards), "exam ends before it starts")
    )


def validated(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections that can be used, and the others with their fault."""
    checked = sections.withColumn("fault", faults(F.col("meetings"), F.col("exams"), F.col("is_online")))
    return checked.filter("fault is null").drop("fault"), checked.filter("fault is not null")


def for_clients(sections: DataFrame) -> DataFrame:
    """Renamed and pruned: seats that are left, teachers as one text, the final exam else the first, search by code or name."""
    final = F.coalesce(F.get(F.filter("exams", lambda e: e["exam_type"] == "final"), F.lit(0)), F.get("exams", F.lit(0)))
    return sections.select("id", "term", F.col("course_code").alias("code"), F.coalesce("credits", F.lit(3)).alias("credits"), F.greatest(F.col("seat_total") - F.col("seat_taken"), F.lit(0)).alias("seats_available"), F.array_join("teachers", ", ").alias("teacher"), F.transform("meetings", lambda m: F.struct(m["day"].alias("day_of_week"), m["start_min"].alias("start"), m["end_min"].alias("end"))).alias("meetings"), final.alias("exam"))


def search(sections: DataFrame, codes: list[str] | None = None, q: str | None = None, day: int | None = None, teacher: str | None = None) -> DataFrame:
    """By codes, else by a text in code or names; and by a meeting's day and a part of a teacher's name."""
    out = sections
    if codes:
        out = out.filter(F.upper(F.trim("course_code")).isin([c.strip().upper() for c in codes]))
    elif q:
        out = out.filter(F.contains(F.lower(F.concat_ws("\n", "course_code", "name_th", "name_en")), F.lit(q.lower())))
    if day is not None:
        out = out.filter(F.exists("meetings", lambda m: m["day"] == day))
    if teacher:
        out = out.filter(F.exists("teachers", lambda t: F.contains(F.lower(t), F.lit(teacher.lower()))))
    return out


def score(sections: DataFrame, avoid_morning: bool, free_days: list[int], used_days: list[int], teachers: list[str]) -> DataFrame:
    """Adds how well a section suits: free seats, no early class, free days kept free, days that are used anyway, teachers."""
    days = F.transform("meetings", lambda m: m["day"])
    ints = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    early = F.coalesce(F.array_min(F.transform("meetings", lambda m: m["start_min"])), F.lit(540)) < 540
    points = F.when(F.col("seat_total") > 0, 2.0 * (F.col("seat_total") - F.coalesce("seat_taken", F.lit(0))) / F.col("seat_total")).otherwise(0.0)
    points = points - F.when(F.lit(avoid_morning) & early, 4.0).otherwise(0.0) - F.when(F.arrays_overlap(days, ints(free_days)), 8.0).otherwise(0.0)
    points = points + F.when(F.arrays_overlap(days, ints(used_days)), 1.5).otherwise(0.0) + F.when(F.arrays_overlap(F.coalesce("teachers", F.array().cast("array<string>")), F.array(*map(F.lit, teachers)).cast("array<string>")), 3.0).otherwise(0.0)
    return sections.withColumn("score", points)
