"""Server-sent events as text: events are blocks between blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(event: Column, data: Column) -> Column:
    """One event with its name and a JSON object."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def parse(streams: DataFrame, column: str) -> DataFrame:
    """One row an event: the other columns, position, event (``message`` where none is named) and data (a JSON object).

    Lines end with LF or CRLF; comments and other fields are skipped, data lines are joined, events without a JSON
    object are dropped. A last block without a blank line counts.
    """
    blocks = streams.select(*(c for c in streams.columns if c != column), F.posexplode(F.split(F.regexp_replace(column, "\r\n?", "\n"), "\n\n+")).alias("position", "block"))
    lines = F.split("block", "\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(name))), lambda x: F.ltrim(F.substr(x, F.lit(len(name) + 1))))
    rows = blocks.withColumn("event", F.coalesce(F.element_at(F.concat(F.array(F.lit("message")), field("event:")), -1), F.lit("message"))).withColumn("data", F.array_join(field("data:"), "\n"))
    return rows.filter(F.startswith(F.ltrim("data"), F.lit("{")) & F.try_parse_json("data").isNotNull()).drop("block")
