"""Other sections that fit a plan, against plain Python."""

import random

from termloom.operators import intervals


def test_fitting_alternatives(spark):
    rng = random.Random(5)
    pool = {(p, s): (rng.randrange(1, 64), rng.random() < 0.2) for p in range(6) for s in range(5)}
    chosen = sorted({(plan, p, s) for plan in range(30) for p, s in rng.sample(sorted(pool), rng.randrange(1, 5))})
    a = spark.createDataFrame([(*c, pool[c[1:]][0]) for c in chosen], "plan long, part long, section long, mask long")
    b = spark.createDataFrame([(*k, m, full or None) for k, (m, full) in pool.items()], "part long, section long, mask long, full boolean")
    want = set()
    for plan, p, s in chosen:
        kept = 0
        for other, q, t in chosen:
            if other == plan and q != p:
                kept |= pool[q, t][0]
        free = [t for (q, t), (m, full) in pool.items() if q == p and t != s and not full and not m & kept]
        if free:
            want.add((plan, p, s, min(free)))
    got = [tuple(r) for r in intervals.fitting_alternatives(a, b, "plan", "part", "section").collect()]
    assert set(got) == want and len(got) == len(want) > 10
    assert intervals.fitting_alternatives(a.limit(0), b, "plan", "part", "section").count() == 0
