"""Queries over the driver's tables, one module a group; each module has QUERIES and ORACLE_SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.queries import assist, events, graphs, pages, parsing, relational, texts, timetable

GROUPS = (events, relational, timetable, texts, assist, parsing, graphs, pages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for group in GROUPS for k, f in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for group in GROUPS for k, sql in group.ORACLE_SQL.items()}
