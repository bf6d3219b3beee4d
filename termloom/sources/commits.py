"""Texts of a version history: commit lines, and numbers of changed lines under an author's line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def commit_lines(lines: DataFrame, separator: str) -> DataFrame:
    """value -> sha, author, date, subject; lines without exactly four fields are dropped."""
    f = F.split("value", "\\Q" + separator + "\\E", -1)
    return lines.select(f.alias("f")).filter(F.size("f") == 4).select(F.left(F.get("f", F.lit(0)), F.lit(7)).alias("sha"), F.get("f", F.lit(1)).alias("author"), F.get("f", F.lit(2)).alias("date"), F.get("f", F.lit(3)).alias("subject"))


def changed_lines(lines: DataFrame, log: str, position: str, separator: str) -> DataFrame:
    """log, position, value -> author, added, deleted, path: the author of the last header line before; binary files have null numbers."""
    mark = "@" + separator
    head = F.when(F.startswith("value", F.lit(mark)), F.substr("value", F.lit(len(mark) + 1)))
    w = Window.partitionBy(log).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("author", F.last(head, ignorenulls=True).over(w)).filter(head.isNull() & F.col("author").isNotNull() & F.contains("value", F.lit("\t")))
    f = F.split("value", "\t")
    return rows.select("author", F.get(f, F.lit(0)).try_cast("int").alias("added"), F.get(f, F.lit(1)).try_cast("int").alias("deleted"), F.get(f, F.lit(2)).alias("path"))


def module_of(path, modules: list[str]):
    """The first module whose folder the path lies in, else null."""
    return F.coalesce(*(F.when(F.startswith(path, F.lit(m + "/")), F.lit(m)) for m in modules))
