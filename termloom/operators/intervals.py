"""Timetable algebra over half-hour slots and exact intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def masks(meetings: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """One mask for each key: the bits of all its rows."""
    return meetings.groupBy(*keys).agg(F.bit_or(mask).alias(mask))


def clashes(sections: DataFrame, within: list[str], key: str, mask: str = "mask") -> DataFrame:
    """Pairs a < b of sections that share bits, inside each group of the equality keys ``within``."""
    own = sections.filter(F.col(mask) != 0)
    a, b = (own.select(*within, F.col(key).alias(x), F.col(mask).alias(f"{x}_mask")) for x in "ab")
    return a.join(b, within).filter("a < b").withColumn("both", F.col("a_mask").bitwiseAND(F.col("b_mask"))).filter("both <> 0").select(*within, "a", "b", "both")


def islands(masked: DataFrame, keys: list[str], mask: str, slots: int) -> DataFrame:
    """Runs of consecutive set bits: first slot and the slot after the last."""
    bits = masked.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.getbit(F.col(mask), i))).alias("slot", "bit")).filter("bit = 1")
    run = F.col("slot") - F.row_number().over(Window.partitionBy(*keys).orderBy("slot"))
    return bits.withColumn("run", run).groupBy(*keys, "run").agg(F.min("slot").alias("first"), (F.max("slot") + 1).alias("after")).drop("run")


def overlaps(rows: DataFrame, within: list[str], key: str, start: str, end: str, days: int = 30) -> DataFrame:
    """Pairs a < b whose half-open date intervals meet, with the common part; touching is no overlap.

    Intervals are dealt into buckets of ``days`` days, so that only those near each other in time are compared; a pair
    counts in the bucket where its common part begins.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    dealt = rows.select(*within, F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).filter("s < e")
    dealt = dealt.withColumn("bucket", F.explode(F.sequence(bucket(F.col("s")), bucket(F.date_sub("e", 1)))))
    a, b = (dealt.select(*within, "bucket", F.col("k").alias(x), F.col("s").alias(f"{x}_start"), F.col("e").alias(f"{x}_end")) for x in "ab")
    met = a.join(b, [*within, "bucket"]).filter("a < b and a_start < b_end and b_start < a_end")
    met = met.withColumn("from", F.greatest("a_start", "b_start")).filter(bucket(F.col("from")) == F.col("bucket"))
    return met.select(*within, "a", "b", "from", F.least("a_end", "b_end").alias("to"))


def near_another(rows: DataFrame, within: list[str], order: list[str], day: str, days: int) -> DataFrame:
    """Rows less than ``days`` days from some other of their group: the one before or after is the nearest."""
    w = Window.partitionBy(*within).orderBy(day, *order)
    gap = F.least(F.datediff(F.col(day), F.lag(day).over(w)), F.datediff(F.lead(day).over(w), F.col(day)))
    return rows.withColumn("__gap", gap).filter(F.col("__gap") < days).drop("__gap")


def lanes_groups(rows: DataFrame, within: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Groups of intervals that overlap one after another: a new group begins where all earlier ones have ended."""
    w = Window.partitionBy(*within).orderBy(start, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) >= before, F.lit(True)).cast("int")
    return rows.withColumn("lane_group", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def lanes(rows: DataFrame, group: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """A lane for each interval of a group of overlapping ones: the first lane that is free again at its start.

    ``start`` and ``end`` are whole numbers. The choice depends on earlier ones, so a group is folded in order; groups
    are as long as intervals overlap one another.
    """
    listed = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(start, *order, F.col(end).cast("long").alias("__end")))).alias("rows"))

    def place(acc, x):
        free = F.array_position(F.transform(acc["ends"], lambda e: e <= x[start]), F.lit(True))  # from 1; 0 where none is
        at = F.when(free > 0, free - 1).otherwise(F.size(acc["ends"])).cast("int")
        ends = F.when(free > 0, F.transform(acc["ends"], lambda e, i: F.when(i == at, x["__end"]).otherwise(e))).otherwise(F.concat(acc["ends"], F.array(x["__end"])))
        return F.struct(ends.alias("ends"), F.concat(acc["lanes"], F.array(at)).alias("lanes"))

    begin = F.struct(F.array().cast("array<long>").alias("ends"), F.array().cast("array<int>").alias("lanes"))
    done = listed.withColumn("plan", F.aggregate("rows", begin, place))
    flat = done.select(*group, F.size("plan.ends").alias("n_lanes"), F.explode(F.arrays_zip(F.col("rows"), F.col("plan.lanes").alias("lane"))).alias("z"))
    return flat.select(*group, *(F.col(f"z.rows.{c}").alias(c) for c in order), F.col("z.lane").alias("lane"), "n_lanes")


def others_mask(parts: DataFrame, plan: str, part: str, mask: str) -> DataFrame:
    """plan, part, kept: the slots that all other parts of a plan take, by what stands before and after a part.

    Masks of one part are joined first, so a part never stands in its own way; a plan's only part has 0.
    """
    own = parts.groupBy(plan, part).agg(F.bit_or(mask).alias("own"))
    w = Window.partitionBy(plan).orderBy(part)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    side = lambda over: F.coalesce(F.bit_or("own").over(over), F.lit(0).cast("long"))
    return own.select(plan, part, side(before).bitwiseOR(side(after)).alias("kept"))


def fitting_alternatives(chosen: DataFrame, pool: DataFrame, plan: str, part: str, section: str) -> DataFrame:
    """plan, part, section, to: for each chosen section the smallest other one of its part with seats that meets none of
    the plan's other parts. ``chosen`` and ``pool`` have part, section, mask, the pool full as well (null: not full)."""
    kept = others_mask(chosen, plan, part, "mask")
    own = chosen.select(plan, part, section).distinct().join(kept, [plan, part])
    other = pool.filter(~F.coalesce("full", F.lit(False))).select(part, F.col(section).alias("to"), F.col("mask").alias("taken"))
    fits = own.join(other, part).filter((F.col("to") != F.col(section)) & (F.col("taken").bitwiseAND(F.col("kept")) == 0))
    return fits.groupBy(plan, part, section).agg(F.min("to").alias("to"))
