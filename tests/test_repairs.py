"""Repairs of plans against a check of every plan that one change makes."""

import random
from collections import Counter

from termloom.operators import planning
from termloom.queries import timetable

CHOSEN = "plan int, section string, course int, slots array<struct<kind: string, at: bigint>>, full boolean, passed boolean"
POOL = "section string, course int, slots array<struct<kind: string, at: bigint>>, full boolean"


def faults(rows):
    """(section or None, code) of a list of (section, course, slots, full, passed)."""
    out = set()
    for i, (section, course, slots, full, passed) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i]
        out |= {(section, kind) for kind, at in slots for r in others if (kind, at) in r[2]}
        out |= {(section, "C6")} if full else set()
        out |= {(section, "C5")} if passed or any(r[1] == course for r in others) else set()
    return out


def expected(plans, pool):
    for plan, rows in plans.items():
        found = faults(rows)
        for bad in rows:
            codes = sorted({c for s, c in found if s == bad[0] and c != "C5"})
            for section, course, slots, full in pool if codes else []:
                if course == bad[1] and section != bad[0] and not full and not faults([r for r in rows if r is not bad] + [(section, course, slots, full, bad[4])]):
                    yield plan, course, bad[0], section, ",".join(codes)


def test_repairs_equal_brute_force(spark):
    dice = random.Random(11)
    pool = [(f"{c}/{n}", c, sorted({("C1", dice.randrange(12)) for _ in range(dice.randrange(3))} | {("C2", dice.randrange(9))}), dice.random() < 0.15) for c in range(12) for n in range(4)]
    plans = {}
    for plan in range(250):
        passed = {c for c in range(12) if dice.random() < 0.03}
        plans[plan] = [(*row, row[1] in passed) for row in dice.sample(pool, dice.randrange(1, 5))]
    df = spark.createDataFrame([(p, *r) for p, rows in plans.items() for r in rows], CHOSEN)
    options = spark.createDataFrame(pool, POOL)
    want = Counter(expected(plans, pool))
    assert len(want) > 50 and {"C1", "C2", "C6"} <= {f for w in want for f in w[4].split(",")}
    assert Counter(map(tuple, planning.repairs(df, options, "plan").collect())) == want
    assert Counter(map(tuple, planning.repairs(df.union(df), options.union(options), "plan").collect())) == want


def test_repairs_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", 1, None, True, None), (1, "b", 2, [("C1", 3)], None, None), (None, "a", 1, None, True, False)], CHOSEN)
    options = spark.createDataFrame([("c", 1, [("C1", 3)], None), ("d", 1, None, None), ("e", None, [("C1", 9)], None), ("f", 1, [("C1", 4)], True)], POOL)
    assert [tuple(r) for r in planning.repairs(df, options, "plan").collect()] == [(1, 1, "a", "d", "C6")]
    assert planning.repairs(df.limit(0), options, "plan").count() == 0 and planning.repairs(df, options.limit(0), "plan").count() == 0


def test_rows_move_once_by_plan_and_once_by_course(spark):
    planned = timetable.plan_repairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < planned.count("Exchange hashpartitioning") <= 3 and "Generate explode(slots" not in planned


def test_repairs_of_long_plans(spark):
    """Many sections that share slots in pairs: no repair; one clash among many: both sections give way."""
    pairs = [(1, f"s{i}", i, [("C1", i // 2)], False, False) for i in range(400)]
    one = [(2, f"s{i}", i, [("C1", i or 399), ("C2", i)], False, False) for i in range(400)]
    df = spark.createDataFrame(pairs + one, CHOSEN)
    options = spark.createDataFrame([("x", 0, [("C1", 1000)], False), ("y", 399, [("C1", 7)], False), ("z", 399, [("C1", 399), ("C2", 399)], False), ("v", 399, [("C1", 399), ("C1", 5000)], False), ("w", 399, [("C2", 399)], None)], POOL)
    assert sorted(map(tuple, planning.repairs(df, options, "plan").collect())) == [(2, 0, "s0", "x", "C1"), (2, 399, "s399", "w", "C1")]
