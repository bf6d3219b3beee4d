"""Exact running totals over a whole table without a window in one partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.storage import written


def running_total(df: DataFrame, order: list[Column], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with column ``out``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are range-sorted; each partition adds up its own rows as they stream by, and the totals of the
    partitions (one number each) give every partition its start. ``order`` must decide ties. A null value
    counts as 0. An empty table gives an empty table. ``df`` must not have columns named ``__part`` and ``__local``.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(own) + total
            total = int(ends[-1]) if len(ends) else total
            yield batch.append_column("__part", pa.array(np.full(len(own), part, np.int32))).append_column("__local", pa.array(ends - own))

    local = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(add_up, schema), "running")
    parts = local.groupBy("__part").agg(F.sum(value).alias("__sum"))
    # one row for each partition of the range sort, whatever the size of the table
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return local.join(F.broadcast(starts), "__part").withColumn(out, F.col("__local") + F.col("__start")).drop("__part", "__local", "__start")
