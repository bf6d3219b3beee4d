"""Times of day, half-hour slots and their bit masks, dates: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timetable runs from 08:00 to 21:00 in slots of 30 minutes.
OPENS, CLOSES, SLOT = 8 * 60, 21 * 60, 30
SLOTS = (CLOSES - OPENS) // SLOT


def hhmm(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)


def to_minutes(text: Column) -> Column:
    """``9:30`` or ``9.30`` -> 570; null where the text is no time."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})[:.](\d{2})\s*$", i).try_cast("int")
    return part(1) * 60 + part(2)


def slot_mask(start: Column, end: Column) -> Column:
    """Bits of the slots that [start, end) touches, clipped to opening hours; 0 where nothing is left."""
    a, b = F.greatest(start, F.lit(OPENS)), F.least(end, F.lit(CLOSES))
    first, last = F.floor((a - OPENS) / SLOT), F.ceil((b - OPENS) / SLOT)
    ones = lambda n: F.expr("1L") * F.pow(F.lit(2.0), n).cast("long")
    return F.when(a < b, ones(last) - ones(first)).otherwise(F.lit(0).cast("long"))


def mask_text(mask: Column) -> Column:
    """One character a slot, the earliest first."""
    return F.reverse(F.lpad(F.bin(mask), SLOTS, "0"))


def first_weekday(start: Column, weekday: Column) -> Column:
    """The first date on or after ``start`` that falls on ``weekday`` (0 is Monday)."""
    return F.date_add(start, F.pmod(weekday - F.weekday(start), F.lit(7)))


def months_between_calendar(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
