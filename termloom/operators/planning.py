"""Plans: greedy choice, where each student's pool is folded by Spark's aggregate, and repairs by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(pool: DataFrame, who: str, order: list[str], cost: str, mask: str, item: str, budget: float) -> DataFrame:
    """Per ``who``, take items in ``order`` while the budget lasts and their mask is free: chosen items and the cost.

    ``order`` columns must decide ties; an item that does not fit is skipped and later ones are still tried.
    """
    rows = pool.groupBy(who).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(cost).cast("double").alias("__cost"), F.col(mask).cast("long").alias("__mask"), F.col(item).cast("string").alias("__item")))).alias("rows"))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("mask"), F.array().cast("array<string>").alias("chosen"))

    def take(acc: Column, x: Column) -> Column:
        fits = (acc["cost"] + x["__cost"] <= budget) & (acc["mask"].bitwiseAND(x["__mask"]) == 0)
        return F.when(fits, F.struct((acc["cost"] + x["__cost"]).alias("cost"), acc["mask"].bitwiseOR(x["__mask"]).alias("mask"), F.concat(acc["chosen"], F.array(x["__item"])).alias("chosen"))).otherwise(acc)

    done = rows.select(who, F.aggregate("rows", start, take).alias("plan"))
    return done.select(who, F.array_join("plan.chosen", ",").alias("chosen"), F.size("plan.chosen").alias("n_chosen"), F.round("plan.cost", 2).alias("cost"))


def relaxed(pool: DataFrame, who: str, order: list[str], cost: str, mask: str, item: str, budget: float, least: float, ladder: list[tuple[str, str, bool]]) -> DataFrame:
    """Per ``who`` the plan of the first level of ``ladder`` (name, condition on items, whether ``least`` cost is asked).

    Levels are tried in order; a level has a plan where greedy() chooses items and their cost reaches ``least`` or none is
    asked. Whoever has no plan on any level is ``infeasible``.
    """
    plans = None
    for n, (name, condition, bounded) in enumerate(ladder):
        found = greedy(pool.filter(condition), who, order, cost, mask, item, budget)
        found = found.filter((F.col("n_chosen") > 0) & (F.col("cost") >= (least if bounded else 0.0))).withColumn("level", F.lit(n)).withColumn("status", F.lit(name))
        plans = found if plans is None else plans.unionByName(found)
    first = plans.groupBy(who).agg(F.min_by(F.struct("status", "chosen", "n_chosen", "cost"), "level").alias("p"))
    everyone = pool.select(who).distinct()
    return everyone.join(first, who, "left").select(who, F.coalesce("p.status", F.lit("infeasible")).alias("status"), "p.chosen", "p.n_chosen", "p.cost")


def repairs(chosen: DataFrame, pool: DataFrame, plan: str) -> DataFrame:
    """plan, course, from, to, faults: every change of one section that leaves its whole plan without a fault.

    ``chosen`` has plan, section, course, slots (array of struct(kind, at): the times it takes, kind C1 for meetings and
    C2 for exams, in a unit that is exact), full, passed; ``pool`` has section, course, slots, full. A section is at fault
    if it shares a slot (C1, C2) or is full (C6); it may give way to another section of its course with seats. The plan
    that results is checked anew: no slot taken twice, no full section, no course twice or already passed (C5).

    No pairs within a plan: its slots are sorted once, and shared ones stand side by side. Without a section no slot is
    shared if none has three takers and every one with two is the section's own, so a plan has two such sections at most.
    Each meets the others of its course once, with the slots that the rest of its plan takes beside it, so rows move once
    by plan and once by course; input that is dealt by plan (pool: by course) already does not move for it. Repeated rows
    count once; null slots are none, null flags are false; rows of a null plan have no repairs, empty tables none either.
    """
    none = F.array().cast("array<string>")
    # a slot as one string, at before kind: a number holds no colon
    flat = F.coalesce(F.transform("slots", lambda s: F.concat(F.coalesce(s["at"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(s["kind"], F.lit("")))), none)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    merged = F.array_distinct(F.flatten(F.collect_set("slots")))
    own = chosen.filter(F.col(plan).isNotNull()).select(plan, "section", "course", flat.alias("slots"), flag("full"), flag("passed"))
    own = own.groupBy(plan, "section", "course").agg(merged.alias("slots"), F.bool_or("full").alias("full"), F.bool_or("passed").alias("passed"))
    rows = F.collect_list(F.struct("section", "course", "slots", "full"))
    plans = own.groupBy(plan).agg(rows.alias("rows"), F.count_if("full").alias("n_full"), F.count("*").alias("n"), F.size(F.collect_set(F.struct("course"))).alias("courses"), F.bool_or("passed").alias("again"))
    plans = plans.filter((F.col("n") == F.col("courses")) & ~F.col("again") & (F.col("n_full") < 2)).select(plan, "rows", "n_full", F.sort_array(F.flatten("rows.slots")).alias("taken"))
    before = lambda x, i, back: (i >= back) & (x == F.get("taken", F.greatest(i - back, F.lit(0))))
    plans = plans.filter(~F.exists(F.transform("taken", lambda x, i: before(x, i, 2)), lambda x: x)).withColumn("twice", F.filter("taken", lambda x, i: before(x, i, 1)))

    at_fault = lambda r: ((F.size("twice") > 0) | r["full"]) & (F.col("n_full") == r["full"].cast("int")) & (F.size(r["slots"]) >= F.size("twice")) & (F.size(F.array_intersect("twice", r["slots"])) == F.size("twice"))
    bad = plans.filter((F.size("twice") > 0) | (F.col("n_full") > 0)).select(plan, "taken", "twice", F.explode(F.filter("rows", at_fault)).alias("r")).filter("r.section is not null")
    kinds = F.filter(F.array_distinct(F.transform("twice", lambda s: F.regexp_replace(s, "^[^:]*:", ""))), lambda k: k != "")
    faults = F.array_join(F.array_sort(F.concat(kinds, F.when(F.col("r.full"), F.array(F.lit("C6"))).otherwise(none))), ",")
    rest = F.concat(F.filter("taken", lambda s: ~F.array_contains("r.slots", s)), "twice")
    bad = bad.select(plan, "r.course", F.col("r.section").alias("from"), faults.alias("faults"), rest.alias("rest"))
    seats = pool.filter(~F.coalesce("full", F.lit(False))).select("course", F.col("section").alias("to"), flat.alias("slots")).groupBy("course", "to").agg(merged.alias("theirs"))
    return bad.join(seats, "course").filter((F.col("to") != F.col("from")) & ~F.arrays_overlap("theirs", "rest")).select(plan, "course", "from", "to", "faults")
