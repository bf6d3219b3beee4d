"""Texts that are similar by their plain shingles only."""

import numpy as np

from termloom.llm import minhash

rng = np.random.default_rng(12)
VOCABULARY = ["".join(rng.choice(list("abcdeéilnoprstu"), rng.integers(2, 9))) for _ in range(600)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def test_near_duplicates_by_plain_shingles(spark):
    """Half of the shingles stand twice in one copy and twenty times in the other: plain similarity about 1, weighted about 0.5."""
    rows = []
    for i in range(40):
        own, line = prose(60), prose(60)
        rows += [(2 * i, " ".join([own, *[line] * 2])), (2 * i + 1, " ".join([own, *[line] * 20]))]
    sets = [minhash.shingles(t) for _, t in rows]
    assert all(minhash.similarity(sets[2 * i], sets[2 * i + 1]) >= minhash.SIMILAR for i in range(40))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_links_are_named_for_what_they_count(spark):
    text = prose(200)
    rows = [(i, f"{text} w{i}") for i in range(30)]  # each is similar to 29 others
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.columns == ["doc_id", "class_id", "join_links"]
    assert all(r["class_id"] == 0 and 1 <= r["join_links"] <= 29 for r in found.collect())


def test_copies_that_are_joined_are_not_compared_again(spark, monkeypatch):
    """Copies of one text share buckets with many centres; a link to one of these is enough."""
    base, rows = list(prose(300)), []
    for i in range(300):
        own = list(base)
        own[int(rng.integers(300))] = f"e{i}"
        rows.append((i, " ".join(own)))
    judged, verified = [], minhash._verified

    def counted(pairs, texts):
        judged.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(minhash, "_verified", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}
    assert sum(judged) < 400


def test_pairs_across_components(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 9), (8, 9)], "a long, b long")
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    assert sorted(map(tuple, minhash._across(pairs, parts).collect())) == [(1, 3), (3, 9), (8, 9)]


def test_sketch_of_unit_weights_is_the_general_one(monkeypatch):
    """Unit weights are taken without the test of the region; a weight just above 1 sees the same darts but for its second cell."""
    elements = minhash.shingles(prose(120))[0]
    plain = minhash.sketch(elements, np.ones(len(elements)))
    near = minhash.sketch(elements, np.full(len(elements), 1 + 1e-12))
    assert (plain == near).mean() > 0.99
