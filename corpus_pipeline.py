"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

An empty table stays empty through all stages. Stages but the last keep all columns, whatever their names (but for those
that begin with two underscores). Null texts go in the first stage, as they have no language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import langid, leaks, minhash, packing, repeats
from termloom.llm.storage import discard, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; null texts and texts without letters go."""
    return langid.keep_identified(docs, langid.train_on(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, that of the smallest doc_id; repeated rows and null ids are judged too."""
    return minhash.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that stand more than once in the corpus."""
    return repeats.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no benchmark item leaks, each judged by its own text (by a hash of it), whatever its doc_id."""
    rows = docs.withColumn("__text", F.xxhash64("text"))
    found = leaks.benchmark_leaks(rows.select(F.col("__text").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__text")).distinct()
    return rows.join(found, "__text", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("decontaminate", decontaminate),
    ("packing", packed),
]

#: The stages learn models, sort by hashes and search by similarity: SQL can't say that. The tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage. A stage's table is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).select(*(c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), F.octet_length("ids").alias("piece_bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
