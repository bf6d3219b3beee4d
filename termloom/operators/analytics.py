"""Event analytics: summaries, duplicates, rate limits, retention, histograms, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def p95(value: Column) -> Column:
    """Nearest rank; nulls do not count."""
    return F.percentile_disc(0.95, value) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value._jc})")


def summary(events: DataFrame, by: str, value: str, least: float) -> DataFrame:
    """Count, nearest-rank 95th percentile, null-safe sum and the share of values of at least ``least``."""
    return events.groupBy(by).agg(
        F.count("*").alias("n"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
        F.round(F.sum(F.coalesce(F.col(value), F.lit(0.0))), 4).alias("total"),
        F.round(F.count_if(F.col(value) >= least) / F.count("*"), 4).alias("share"),
    )


def ingest(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``accepted``: the first row of each key in ``order``, and every row whose key is null."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return events.withColumn("accepted", F.col(key).isNull() | first)


def rate_limit(events: DataFrame, who: str, ts: str, seconds: int, limit: int, order: list[Column]) -> DataFrame:
    """Adds the fixed window of each event, its place there and whether the limit is passed."""
    window = (F.floor(F.unix_timestamp(ts) / seconds) * seconds).alias("window_start")
    own = events.withColumn("window_start", window)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(who, "window_start").orderBy(*order))).withColumn("rejected", F.col("place") > limit)


def sessions(events: DataFrame, who: str, ts: str, gap_seconds: int, order: list[Column]) -> DataFrame:
    """Session numbers from 1: a session ends where the next event is more than the gap away."""
    w = Window.partitionBy(who).orderBy(*order)
    new = F.coalesce(F.unix_timestamp(ts) - F.lag(F.unix_timestamp(ts)).over(w) > gap_seconds, F.lit(True))
    return events.withColumn("session", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_histogram(df: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """A row for each key and bound: how many values are at most the bound; the last bound is infinite."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(by).agg(*counts, F.count(value).alias(f"le_{len(bounds)}"))
    labels = [*map(str, bounds), "+Inf"]
    return wide.unpivot([by], [f"le_{i}" for i in range(len(labels))], "bound", "n").replace({f"le_{i}": x for i, x in enumerate(labels)}, subset=["bound"])
