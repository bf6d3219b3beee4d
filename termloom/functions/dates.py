"""Days, times, terms and dates of the Buddhist calendar as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of days, 0 is Monday.
DAYS = {
    "จ": 0, "จ.": 0, "จันทร์": 0, "mon": 0, "monday": 0,
    "อ": 1, "อ.": 1, "อังคาร": 1, "tue": 1, "tuesday": 1,
    "พ": 2, "พ.": 2, "พุธ": 2, "wed": 2, "wednesday": 2,
    "พฤ": 3, "พฤ.": 3, "พฤหัส": 3, "พฤหัสบดี": 3, "thu": 3, "thursday": 3,
    "ศ": 4, "ศ.": 4, "ศุกร์": 4, "fri": 4, "friday": 4,
    "ส": 5, "ส.": 5, "เสาร์": 5, "sat": 5, "saturday": 5,
    "อา": 6, "อา.": 6, "อาทิตย์": 6, "sun": 6, "sunday": 6,
}
#: Short and long names of months.
MONTHS = {
    "ม.ค.": 1, "ก.พ.": 2, "มี.ค.": 3, "เม.ย.": 4, "พ.ค.": 5, "มิ.ย.": 6, "ก.ค.": 7, "ส.ค.": 8, "ก.ย.": 9, "ต.ค.": 10, "พ.ย.": 11, "ธ.ค.": 12,
    "มกราคม": 1, "กุมภาพันธ์": 2, "มีนาคม": 3, "เมษายน": 4, "พฤษภาคม": 5, "มิถุนายน": 6, "กรกฎาคม": 7, "สิงหาคม": 8, "กันยายน": 9, "ตุลาคม": 10, "พฤศจิกายน": 11, "ธันวาคม": 12,
}
#: How time ranges, meetings of a week and dates are written.
RANGE = r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})"
MEETING = r"([ก-๙a-zA-Z.]+)\s*(\d{1,2}[:.]\d{2})\s*[-–~]\s*(\d{1,2}[:.]\d{2})"
DATE = r"(\d{1,2})\s+(\S+?\.?)\s+(\d{4})"
#: Years from here on are Buddhist, and how far those are ahead.
BUDDHIST_FROM, AHEAD = 2400, 543


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def day_number(name: Column) -> Column:
    """0 to 6, null for an unknown name."""
    return _map(DAYS)[F.lower(F.trim(name))]


def minutes(clock: Column) -> Column:
    part = F.split(clock, "[:.]")
    return F.get(part, F.lit(0)).try_cast("int") * 60 + F.get(part, F.lit(1)).try_cast("int")


def time_range(text: Column) -> Column:
    """``13:00 - 15:00`` anywhere in the text -> start and end in minutes; null where there is none."""
    return F.when(text.rlike(RANGE), F.struct(minutes(F.regexp_extract(text, RANGE, 1)).alias("start_min"), minutes(F.regexp_extract(text, RANGE, 2)).alias("end_min")))


def schedule(text: Column) -> Column:
    """``จ. 09:00-12:00, FRI 13.00-16.00`` -> an array of day, start and end; parts that can't be read are left out."""
    part = lambda x, i: F.regexp_extract(x, MEETING, i)
    read = F.transform(F.split(F.trim(text), r"[,;\n]+"), lambda x: F.struct(day_number(part(x, 1)).alias("day"), minutes(part(x, 2)).alias("start_min"), minutes(part(x, 3)).alias("end_min")))
    return F.filter(read, lambda m: m["day"].isNotNull() & m["start_min"].isNotNull() & m["end_min"].isNotNull())


def common_year(year: Column) -> Column:
    return F.when(year > BUDDHIST_FROM, year - AHEAD).otherwise(year)


def thai_date(text: Column) -> Column:
    """``5 ก.ย. 2569`` anywhere in the text -> 2026-09-05; null where there is no such date."""
    part = lambda i: F.regexp_extract(text, DATE, i)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", common_year(part(3).try_cast("int")), _map(MONTHS)[part(2)], part(1).try_cast("int")), "yyyy-MM-dd")


def thai_text(date: Column) -> Column:
    """2026-09-05 -> ``5 กันยายน 2569``."""
    names = {n: name for name, n in MONTHS.items()}  # the long names stand last
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), _map(names)[F.month(date)], (F.year(date) + AHEAD).cast("string"))


def term(text: Column) -> Column:
    """``3/66`` -> ``3/2566``; null for other texts."""
    return F.when(text.rlike(r"^\d/\d{2}"), F.regexp_replace(F.substring(text, 1, 4), "/", "/25"))


def entry_year(student_id: Column, century: int = 2500) -> Column:
    """The Buddhist year that the id's second and third digit name."""
    return F.substring(student_id, 2, 2).try_cast("int") + century


def study_year(entry: Column, now: int) -> Column:
    return F.greatest(F.lit(1), F.lit(now) - entry + 1)


def midpoint(start: Column, end: Column, slot: int = 30) -> Column:
    """The middle of a time range, down to a whole slot."""
    return (F.floor((start + end) / 2 / slot) * slot).cast("int")


def stamp(date: Column, minute: Column) -> Column:
    """Local time as calendars write it: ``20260905T093000``."""
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit("T"), F.format_string("%02d%02d00", F.floor(minute / 60), minute % 60))
