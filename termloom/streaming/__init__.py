"""Streaming twins of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_of(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """A file stream of a Parquet table."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(parent if glob == name else path)


def deduplicated(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first event of each key while the watermark remembers it; events without a key all pass.

    State is bounded by ``late``: a key that returns later than that is new again.
    """
    known = events.filter(F.col(key).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return known.unionByName(events.filter(F.col(key).isNull()).withWatermark(ts, late))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))


def drained(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over what there is, to Parquet, and read the result."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def updated(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Run a stream of changing rows over what there is; the last row of each key is the result.

    Each batch is written under its number, so a batch that is tried again replaces itself.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/{number:09d}")

    query = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{path}/data")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, *(f"last.{c}" for c in rest))


def event_time(events: DataFrame, own: str, arrived: str, out: str) -> DataFrame:
    """``out`` is the time an event says it happened, else that of its arrival; late events keep their own time."""
    return events.withColumn(out, F.coalesce(F.col(own), F.col(arrived)).cast("timestamp"))


def split_batch(events: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The batch and whether its size is allowed; a batch of more than ``most`` events is refused whole."""
    return events, events.limit(most + 1).count() <= most


def transcript(parts: DataFrame, session: str, order: str, text: str, ts: str, idle_seconds: int) -> DataFrame:
    """Parts of streamed answers joined in order, with their end: ``complete`` where a part is final, else ``interrupted``
    where the pause before some part is longer than allowed, else ``cancelled``. ``parts`` has a boolean ``final``."""
    w = Window.partitionBy(session).orderBy(order)
    pause = F.unix_timestamp(ts) - F.lag(F.unix_timestamp(ts)).over(w)
    rows = parts.withColumn("__late", F.coalesce(pause > idle_seconds, F.lit(False)))
    g = rows.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("p"), F.bool_or("final").alias("final"), F.bool_or("__late").alias("late"))
    return g.select(session, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("message"), F.when(F.col("final"), "complete").when(F.col("late"), "interrupted").otherwise("cancelled").alias("status"))
