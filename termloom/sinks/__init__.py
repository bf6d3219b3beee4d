"""Results as texts and tables: calendars, metrics, last writes, inserts that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import dates, slots
from termloom.functions.text import escape_calendar

#: Weekdays as calendars write them, from Monday on.
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def calendar(meetings: DataFrame, plan: str, prodid: str) -> DataFrame:
    """One calendar text a plan: a weekly event for each meeting that falls before the end.

    ``meetings``: the plan, position, title, location, day (0 is Monday), start_min, end_min, from_date, to_date.
    """
    first = slots.first_weekday(F.col("from_date"), F.col("day"))
    code = F.element_at(F.array(*map(F.lit, WEEKDAYS)), (F.col("day") + 1).cast("int"))
    line = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(plan).cast("string"), F.lit("-"), F.col("position").cast("string")), F.concat(F.lit("SUMMARY:"), escape_calendar(F.col("title"))),
        F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit("LOCATION:"), escape_calendar(F.col("location")))), F.concat(F.lit("DTSTART:"), dates.stamp(first, F.col("start_min"))), F.concat(F.lit("DTEND:"), dates.stamp(first, F.col("end_min"))),
        F.concat(F.lit("RRULE:FREQ=WEEKLY;BYDAY="), code, F.lit(";UNTIL="), F.date_format("to_date", "yyyyMMdd"), F.lit("T235959")), F.lit("END:VEVENT"),
    )
    events = meetings.filter(first <= F.col("to_date")).groupBy(plan).agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("e"))
    every = meetings.select(plan).distinct().join(events, plan, "left")
    head = f"BEGIN:VCALENDAR\r\nPRODID:{prodid}\r\nVERSION:2.0\r\n"
    return every.select(plan, F.concat(F.lit(head), F.array_join(F.transform(F.coalesce("e", F.array().cast("array<struct<position: int, line: string>>")), lambda x: F.concat(x["line"], F.lit("\r\n"))), ""), F.lit("END:VCALENDAR\r\n")).alias("ics"))


def last_write(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key, with all columns."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return messages.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def insert_new(existing: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key is neither there nor earlier among the rows; rows without a key always count as new."""
    named = rows.filter(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti").select(rows.columns)
    w = Window.partitionBy(key).orderBy(*order)
    first = named.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.unionByName(rows.filter(F.col(key).isNull()))


def delete_of(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of ``gone``'s keys, and how many rows each loses."""
    counts = None
    for name, t in tables.items():
        n = t.join(gone.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted")).withColumn("name", F.lit(name))
        counts = n if counts is None else counts.unionByName(n)
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}, counts


def with_positions(plans: DataFrame, plan: str, items: str) -> DataFrame:
    """A row for each item of a plan's list, numbered from 0."""
    return plans.select(plan, F.posexplode(items).alias("position", "item"))


def metric_lines(histogram: DataFrame, name: str, label: str) -> DataFrame:
    """``name_bucket{label="x",le="10.0"} 3`` for each row of label, bound and n, in the order of label and bound."""
    line = F.format_string(f'{name}_bucket{{{label}="%s",le="%s"}} %d', F.col(label), F.col("bound"), F.col("n"))
    place = F.when(F.col("bound") == "+Inf", F.lit(float("inf"))).otherwise(F.col("bound").try_cast("double"))
    return histogram.select(label, F.struct(place.alias("le"), line.alias("line")).alias("x")).groupBy(label).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"))
