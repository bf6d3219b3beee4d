"""Small helpers for functions given to mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int = 256) -> Iterator[list[list]]:
    """Python lists of the named columns, a few rows at a time, so that few texts are held as objects at once."""
    for batch in batches:
        found = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for at in range(0, batch.num_rows, rows):
            yield [c.slice(at, rows).to_pylist() for c in found]


def record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
