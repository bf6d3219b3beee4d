"""Whitening of vectors: Welford's updates in each partition, merged by the parallel update, and a symmetric QR eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries beyond this are held there, so that sums stay exact.
FURTHEST = 2.0**40
#: Vectors that are updated or projected at a time.
AT_ONCE = 2048


class Moments:
    """Count, exact sums, mean, and summed products of deviations of vectors that stream by."""

    def __init__(self, d: int) -> None:
        self.n, self.sums, self.mean, self.m2 = 0, np.zeros(d, object), np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's update for each row in turn: the running means come from running sums, and the rank-one terms, deviation
        from the mean before times deviation from the mean after, are added up by one product."""
        if not len(x):
            return
        k = np.arange(self.n + 1, self.n + len(x) + 1, dtype=float)[:, None]
        from_mean = x - self.mean
        after = np.cumsum(from_mean, axis=0) / k  # means relative to the one so far
        before = np.vstack([np.zeros((1, x.shape[1])), after[:-1]])
        self.m2 += (from_mean - before).T @ (from_mean - after)
        self.mean = self.mean + after[-1]
        self.n += len(x)

    def count(self, x: np.ndarray) -> None:
        self.sums = self.sums + x.sum(axis=0).astype(object)

    def merge(self, other: Moments) -> None:
        """The parallel update of two parts."""
        n = self.n + other.n
        if other.n:
            gap = other.mean - self.mean
            self.m2 += other.m2 + np.outer(gap, gap) * (self.n * other.n / n)
            self.mean = self.mean + gap * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def packed(self) -> tuple[int, str, bytes, bytes]:
        return self.n, ",".join(map(str, self.sums)), self.mean.tobytes(), self.m2.tobytes()

    @staticmethod
    def of(n: int, sums: str, mean: bytes, m2: bytes) -> Moments:
        out = Moments(len(mean) // 8)
        out.n, out.sums, out.mean = n, np.array([int(x) for x in sums.split(",")], object), np.frombuffer(mean).copy()
        out.m2 = np.frombuffer(m2).reshape(len(out.mean), -1).copy()
        return out


STATE = "part int, n long, sums string, mean binary, m2 binary"
STATE_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.string()), ("mean", pa.binary()), ("m2", pa.binary())])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of a list column, all of length d, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scaled(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry, as long."""
    return np.clip(np.floor(SCALE * matrix(column, d)), -FURTHEST, FURTHEST).astype(np.int64) + SHIFT


def state(part: int, m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, *m.packed()), STATE_SCHEMA, strict=True)], schema=STATE_SCHEMA)


def merged(states: DataFrame, d: int) -> Moments:
    """The moments of all partitions. Groups of partitions are merged by tasks, the rest, about a root of their number, here."""
    groups = max(1, math.isqrt(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                part = row.pop("part")
                if total is None:
                    total, first = Moments.of(**row), part
                else:
                    total.merge(Moments.of(**row))
        if total:
            yield state(first, total)

    rows = states.repartition(groups, F.col("part") % groups).sortWithinPartitions("part").mapInArrow(merge, STATE).collect()  # at most ``groups`` states of d x d numbers
    out = Moments(d)
    for r in sorted(rows, key=lambda r: r["part"]):
        out.merge(Moments.of(r["n"], r["sums"], bytes(r["mean"]), bytes(r["m2"])))
    return out


def reduced(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and the turn that make a symmetric matrix tridiagonal, by Householder's reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        largest = np.abs(v).max()
        if largest == 0:
            continue
        v /= largest  # squares of rounding would be lost
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    n = len(a)
    d, e, q = reduced((a + a.T) / 2)
    rows = np.ascontiguousarray(q.T)  # vectors as rows: rotations mix neighbours
    tiny = np.finfo(float).eps
    hi = n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        zeros = np.flatnonzero(e[:hi] == 0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dl, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dl
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dl
            e[k] = c * s * (dl - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = rows[k] * c + rows[k + 1] * s
            rows[k + 1] = rows[k + 1] * c - rows[k] * s
            rows[k] = upper
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (doubles) of the rows whose vector has finite entries only, all of the same length; and that length."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    length = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length["d"] if length else 1
    return own.filter(F.size("v") == d), d


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``vectors`` (vec_id, embedding) and component.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained, identity_error. Rows are left out whose vector is
    null or empty, holds a null or an entry that is not finite, or has another length than most (of equally many the longer).
    Entries beyond 2^40 / 64 count as that. Repeated rows, also of one vec_id, count each; a null vec_id stays null. Components without variance
    (an eigenvalue that is rounding only) can't be scaled and are left out, so equal vectors, a single one or an empty table
    give no rows. A deviation beyond a long is null. Other columns are ignored, whatever their names.
    """
    own, d = usable(vectors)
    spark = vectors.sparkSession

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(d)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                x = scaled(batch.column(1).slice(at, AT_ONCE), d) - SHIFT
                m.count(x)
                m.add(x.astype(float))
        if m.n:
            yield state(TaskContext.get().partitionId(), m)

    m = merged(own.mapInArrow(fit, STATE), d)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if not m.n:
        return spark.createDataFrame([], f"{schema}, identity_error double")
    values, turn = symmetric_eigen(m.m2 / m.n)
    trace = float(np.trace(m.m2)) / m.n
    held = int((values[:components] > d * np.finfo(float).eps * max(values[0], 0)).sum()) if trace > 0 else 0
    values, turn = values[:held], turn[:, :held]
    n, sums = m.n, [int(s) for s in m.sums]  # of entries less SHIFT: n x - S is the same
    mean = np.array([s / n for s in sums])
    schema_arrow = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def deviations(x: np.ndarray) -> list[int | None]:
        furthest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
        if furthest < 2**62 and d * furthest**2 < 2**63:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                x = scaled(batch.column(1).slice(at, AT_ONCE), d) - SHIFT
                ids = batch.column(0).slice(at, AT_ONCE)
                z = (x - mean) @ turn / np.sqrt(values)
                every = np.repeat(np.arange(len(x)), held)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(every)), pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), len(x))), pa.array(np.full(len(every), n)), pa.array(deviations(x), pa.int64()).take(pa.array(every)), pa.array(z.ravel()), pa.array(np.tile(values / trace, len(x)))], schema=schema_arrow)

    if not held:
        return spark.createDataFrame([], f"{schema}, identity_error double")
    return own.mapInArrow(project, schema).withColumn("identity_error", F.lit(identity_error(own, d, lambda x: (x - mean) @ turn / np.sqrt(values), held)))


def identity_error(own: DataFrame, d: int, projected: Callable[[np.ndarray], np.ndarray], held: int) -> float:
    """The largest absolute entry of the projected vectors' covariance minus the identity, measured on all of them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(held)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                m.add(projected(scaled(batch.column(1).slice(at, AT_ONCE), d) - SHIFT))
        if m.n:
            yield state(TaskContext.get().partitionId(), m)

    m = merged(own.mapInArrow(measure, STATE), held)
    return float(np.abs(m.m2 / m.n - np.eye(held)).max())
