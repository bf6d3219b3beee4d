"""Whitened vectors against numpy on the whole table."""

import math

import numpy as np
import pytest

from termloom.llm import queries, whitening

rng = np.random.default_rng(11)
SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def compare(got, rows, components=32):
    """``rows``: vec_id and vector of the rows to be fitted."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x.astype(float) - sums.astype(float) / n)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    held = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * held and {r["component"] for r in got} == set(range(1, held + 1))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(1, held + 1):
        want = centred @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        mine = np.array([by[i][k]["whitened"] for i, _ in rows])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert abs(by[rows[0][0]][k]["explained"] - values[k - 1] / np.trace(v)) < 1e-9
    for i, (vec_id, _) in enumerate(rows):
        assert by[vec_id][1]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) and by[vec_id][1]["n"] == n
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


def test_against_numpy(spark):
    mix = rng.standard_normal((40, 40))
    rows = [(i, (rng.standard_normal(40) @ mix).tolist()) for i in range(500)]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0])]
    compare(whitening.whitened(table(spark, rows + bad)).collect(), rows)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    compare(queries.op11_whitening(spark, "/root/testdata/sf0.01").collect(), rows)


def test_odd_tables(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # one direction only, repeated rows, a null id, other columns
    rows = [(1, [0.0, 0.0], "a", 1), (1, [1.0, 1.0], "b", 2), (None, [2.0, 2.0], "c", 3), (4, [2.0, 2.0], "d", 4)]
    got = whitening.whitened(table(spark, rows, f"{SCHEMA}, whitened string, v int")).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and abs(sum(r["whitened"] for r in got)) < 1e-9 and got[0]["explained"] == pytest.approx(1)
    far = whitening.whitened(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])])).collect()
    assert {(r["vec_id"], r["deviation"]) for r in far} == {(1, None), (2, None), (3, (3 * 4 * 64 - 7 * 64) ** 2)} and far[0]["identity_error"] < 1e-4


@pytest.mark.parametrize("n", [1, 2, 3, 10, 65])
def test_eigen_solver(n):
    for a in (rng.standard_normal((n, n)), np.ones((n, n)), np.diag(np.arange(n) % 3), np.zeros((n, n)), rng.standard_normal((n, max(1, n // 2))) @ rng.standard_normal((max(1, n // 2), n))):
        a = np.asarray(a, float)
        a = a + a.T
        values, vectors = whitening.symmetric_eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-10 * max(1, np.abs(a).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-10 * max(1, np.abs(a).max()))


def test_parts_merge_as_the_whole():
    x = rng.standard_normal((1000, 5)) * 3 + 7
    whole, merged = whitening.Moments(5), whitening.Moments(5)
    whole.add(x)
    for part in np.array_split(x, [0, 1, 17, 400]):
        m = whitening.Moments(5)
        m.add(part)
        merged.merge(whitening.Moments.of(*m.packed()))
    assert merged.n == whole.n == 1000 and np.allclose(merged.m2, whole.m2) and np.allclose(whole.m2 / 1000, np.cov(x.T, bias=True)) and np.allclose(merged.mean, x.mean(axis=0))
