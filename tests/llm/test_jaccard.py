"""The Jaccard join of whole sets against all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import jaccard, queries

rng = np.random.default_rng(12)
VOCABULARY = ["".join(rng.choice(list("abcdeéilnoprstuÉŠ.,"), rng.integers(2, 9))) for _ in range(2000)]


def prose(n):
    return list(rng.choice(VOCABULARY, n))


def edited(words, n):
    own = list(words)
    for k in rng.choice(len(own), n, replace=False):
        own[k] = f"e{rng.integers(10**9)}"
    return own


def plain_set(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", small)
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain(rows):
    """Rows of doc_id, text -> Counter of (doc_id, n_shingles, component_id), by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    links = 0
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j < i)
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                links += 1
                group[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and (low.get(root(i)) is None or d < low[root(i)]):
            low[root(i)] = d
    return Counter((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)), links


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return Counter(tuple(r) for r in jaccard.similar_components(df).select("doc_id", "n_shingles", "component_id").collect())


def test_against_all_pairs(spark):
    """Copies with edits that leave them just above and just below the threshold, shared passages, and one dense group."""
    passage, rows = prose(60), []
    for i in range(150):
        base = prose(int(rng.integers(8, 160)))
        if i % 3 == 0:
            base += passage
        rows += [base, edited(base, max(1, len(base) // 50)), edited(base, max(1, len(base) // 45)), edited(base, max(1, len(base) // 30)), [w.upper() if w.isascii() else w for w in base]]
    hub = prose(200)
    rows += [edited(hub, int(rng.integers(0, 6))) for _ in range(150)]  # from all alike to far below the threshold
    lines = [prose(12) for _ in range(30)]
    rows += [sum((lines[k] for k in rng.permutation(30)[:20]), []) for _ in range(60)]  # of shared lines only
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want, links = plain(rows)
    assert links > 500
    assert found(spark, rows) == want


def test_odd_rows(spark):
    long = " ".join(prose(30_000))
    rows = [(1, None), (2, None), (3, ""), (4, " \t\r\n\x0b\x0c"), (5, "one"), (6, "ONE"), (7, "one two three"), (8, "one  two\tthree"), (9, "three two one"), (10, "\x85 \xa0"), (11, "\x85\xa0")]
    rows += [(20, long), (21, long + " end"), (22, "x" * 5000), (23, "X" * 5000), (None, long), (None, "lonely words stand here"), (None, None), (20, "another text of the same id"), (20, long), (-(2**63), "one")]
    assert found(spark, rows) == plain(rows)[0]
    assert found(spark, rows[:1]) == plain(rows[:1])[0]
    clash = spark.createDataFrame([(1, "a b c d e", "k", 1), (2, "a b c d e", "k", 2)], "doc_id long, text string, key string, node int")
    assert sorted(map(tuple, jaccard.similar_components(clash).collect())) == [(1, 2, 1), (2, 2, 1)]
    assert jaccard.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_third_of_the_rows_is_one_text(spark):
    rows = [(i, "the same text in very many rows of the table" if i % 3 == 0 else " ".join(prose(9))) for i in range(6000)]
    assert found(spark, rows, 8) == plain(rows)[0]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    texts = [" ".join(prose(400)), "y" * 5000 + " z w v u", "\n".join(prose(300)) + " ", None]
    whole = [x.tolist() for x in jaccard.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(jaccard, "AT_ONCE", 300)
    assert [x.tolist() for x in jaccard.shingle_sets(pa.array(texts))] == whole
    assert [len(x) for x in whole] == [len(plain_set(t)) for t in texts]
    sliced = pa.array(["skip me please now", *texts]).slice(1)
    assert [x.tolist() for x in jaccard.shingle_sets(sliced)] == whole


@pytest.mark.parametrize("block", [3, 50])
def test_blocks_take_each_pair_once(spark, block):
    """However small the blocks, each pair of different components that may link comes once."""
    sets = [np.sort(np.concatenate([np.arange(100, 190), np.arange(1000 + 10 * i, 1010 + 10 * i)])).astype(np.uint64) for i in range(20)]
    profiles = spark.createDataFrame([(i, 100, bytearray(s[:40].tobytes()), 20, 139) for i, s in enumerate(sets)], "node long, n long, prefix binary, last_n long, last long")
    members = spark.createDataFrame([(int(g), i, i % 4) for i, s in enumerate(sets) for g in s[:40]], "gram long, node long, component long")
    got = sorted((r["a"], r["b"]) for r in jaccard._apart(members, profiles, block).collect())
    assert got == sorted((i, j) for i in range(20) for j in range(i + 1, 20) if i % 4 != j % 4)


def test_shared_counts(spark):
    """Each node comes once with all its shared shingles, however many tasks have counted some of them."""
    sets = [np.unique(rng.integers(0, 900, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(60)] + [np.arange(10**6 * i, 10**6 * i + 30, dtype=np.uint64) for i in range(1, 9)]
    holders = Counter(int(g) for s in sets for g in s)
    want = {(i << 33) + i: k for i, s in enumerate(sets) if (k := sum(holders[int(g)] > 1 for g in s))}
    nodes = spark.createDataFrame([((i << 33) + i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, sample binary").repartition(7)
    got = jaccard._shared(nodes).collect()
    assert len(got) == len(want) and {r["node"]: r["shared"] for r in got} == want


@pytest.mark.parametrize("most", [1 << 25, 1 << 10])
def test_few_other_texts_meet_the_chosen(spark, monkeypatch, most):
    """A full mask passes more of the other texts, but no mask drops a chosen one."""
    monkeypatch.setattr(jaccard, "MASK", most)
    rows = spark.range(20_000).withColumn("text", F.col("id").cast("string")).select("id", jaccard.digest("text").alias("own"), "text")
    chosen = rows.filter("id % 50 = 0").select(F.col("id").alias("node"), F.col("own").alias("digest"), F.col("id").alias("doc_id"))
    passed = jaccard._may_be_chosen(rows, chosen)
    assert passed.columns == rows.columns
    got = [r["id"] for r in passed.select("id").collect()]
    assert len(got) == len(set(got)) and set(range(0, 20_000, 50)) <= set(got)
    assert len(got) < (3000 if most > 1 << 20 else 12_000)
    assert jaccard._may_be_chosen(rows, chosen.limit(0)).count() == 0


def test_samples_are_deleted(spark, monkeypatch):
    """No table with sampled shingles is left, or stands there when the whole sets are made."""
    live, write, drop = {}, jaccard.written, jaccard.discard
    monkeypatch.setattr(jaccard, "written", lambda df, name: live.setdefault(id(t := write(df, name)), t))
    monkeypatch.setattr(jaccard, "discard", lambda *tables: [live.pop(id(t), None) for t in tables] and drop(*tables))
    whole, seen = jaccard._whole_sets, []
    monkeypatch.setattr(jaccard, "_whole_sets", lambda *a: seen.append([t.columns for t in live.values()]) or whole(*a))
    rows = [(i, f"a text of eight words and number {i // 2}") for i in range(40)]
    assert found(spark, rows) == plain(rows)[0]
    assert len(seen) == 1 and seen[0] and not any("sample" in c for c in seen[0])


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = Counter(tuple(r) for r in queries.op12_ngram_jaccard(spark, "/root/testdata/sf0.01").select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain([tuple(r) for r in docs.collect()])[0]
