"""Near duplicates against all pairs, on a corpus with planted copies of every degree."""

import numpy as np

from termloom.llm import minhash

rng = np.random.default_rng(21)
VOCABULARY = ["".join(rng.choice(list("abcdeéilnoprstu"), rng.integers(2, 9))) for _ in range(1500)]


def prose(n):
    return list(rng.choice(VOCABULARY, n))


def edited(words, n):
    own = list(words)
    for k in rng.choice(len(own), n, replace=False):
        own[k] = f"e{rng.integers(10**9)}"
    return own


def all_pairs(rows):
    """Pairs of rows with a similarity of SIMILAR or more, by comparing each with all."""
    sets = [minhash.shingles(t) for _, t in rows]
    sizes = np.array([len(k) for k, _ in sets])
    holders = {}
    for i, (k, _) in enumerate(sets):
        for x in k.tolist():
            holders.setdefault(x, []).append(i)
    near = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    return {(i, j) for i, j in near if min(sizes[i], sizes[j]) and minhash.similarity(sets[i], sets[j]) >= minhash.SIMILAR}


def test_recall_of_pairs(spark):
    """Over 200 near pairs from 0.8 to 1 among 1,100 documents, repeated lines and one dense group included."""
    rows = []
    for i in range(300):
        base = prose(int(rng.integers(60, 200)))
        if i % 5 == 0:  # a line that repeats
            base += base[:12] * int(rng.integers(2, 6))
        rows += [base, edited(base, max(1, len(base) // 60)), edited(base, max(1, len(base) // 45))]
    hub = prose(150)
    rows += [edited(hub, int(rng.integers(0, 6))) for _ in range(200)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = all_pairs(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    outside = {(i, j) for i, j in want if j < 900}
    assert len(outside) > 200 and len(want) > 2000
    assert sum(got[i] == got[j] for i, j in outside) >= 0.99 * len(outside)
    assert sum(got[i] == got[j] for i, j in want) >= 0.99 * len(want)
    # and no class holds what no chain of similar pairs joins
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, j in want:
        group[max(root(i), root(j))] = min(root(i), root(j))
    assert all(root(i) == root(got[i]) for i in got)


def test_blocks_of_a_bucket(spark):
    """However small the blocks, each pair across components comes once."""
    nodes = spark.createDataFrame([(i, [7, 9]) for i in range(40)], "node long, bands array<long>")
    bits = ([0] * (2 * minhash.PLANES), [])
    members = spark.createDataFrame([(b, i, i % 3, bits) for b in (7, 9) for i in range(40)], "bucket long, node long, component long, bits struct<weighted: array<long>, plain: array<long>>")
    want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 != j % 3)
    for block in (6, 1000):
        assert sorted((r["a"], r["b"]) for r in minhash._apart(members, nodes, block).collect()) == want
