"""Lexical retrieval on postings: BM25, TF-IDF cosine, rank fusion and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of BM25 and of reciprocal rank fusion.
K1, B, RRF_K = 1.5, 0.75, 60


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf and the document's length in tokens.

    Terms are counted inside a document, on its sorted tokens, so that no token is shuffled.
    """
    sorted_tokens = docs.select(key, F.array_sort(tokens).alias("t")).withColumn("length", F.size("t"))
    t = F.col("t")
    begins = F.filter(F.sequence(F.lit(1), F.col("length")), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    counted = sorted_tokens.filter("length > 0").withColumn("b", begins)
    b = F.col("b")
    runs = F.transform(b, lambda x, i: F.struct(F.get(t, x - 1).alias("term"), (F.coalesce(F.get(b, i + 1), F.col("length") + 1) - x).cast("long").alias("tf")))
    return counted.select(key, "length", F.explode(runs).alias("run")).select(key, "length", "run.term", "run.tf")


def frequencies(index: DataFrame) -> DataFrame:
    """Documents that hold each term; a term has one row a document."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25(index: DataFrame, queries: DataFrame, docs_stats: DataFrame, key: str, query: str) -> DataFrame:
    """Scores of documents for queries (query, term; distinct terms). ``docs_stats``: one row n, mean_length."""
    wanted = queries.select(query, "term").distinct()
    # only terms that are asked for leave the index
    hit = index.join(wanted.select("term").distinct(), "term", "left_semi")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weighted = hit.join(frequencies(hit), "term").crossJoin(F.broadcast(docs_stats)).select(key, "term", (idf * tf).alias("w"))  # docs_stats is one row
    return weighted.join(wanted, "term").groupBy(query, key).agg(F.sum("w").alias("score"))


def unit(weighted: DataFrame, key: str) -> DataFrame:
    """key, term, w with each key's w brought to length 1; keys without weight are left out."""
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).filter("norm > 0")
    return weighted.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(rows: DataFrame, df: DataFrame, docs_stats: DataFrame, key: str) -> DataFrame:
    """Unit vectors of tf / length * (ln((n + 1) / (df + 1)) + 1); terms that no document holds have idf 1."""
    idf = F.coalesce(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, F.lit(1.0))
    raw = rows.join(df, "term", "left").crossJoin(F.broadcast(docs_stats)).select(key, "term", (F.col("tf") / F.col("length") * idf).alias("w"))  # docs_stats is one row
    return unit(raw, key)


def tfidf_log(rows: DataFrame, df: DataFrame, docs_stats: DataFrame, key: str) -> DataFrame:
    """Unit vectors of (1 + ln tf) times BM25's idf; terms that no document holds count nothing."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = rows.join(df, "term").crossJoin(F.broadcast(docs_stats)).select(key, "term", ((1 + F.log("tf")) * idf).alias("w"))  # docs_stats is one row
    return unit(raw, key)


def cosine(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Dot products of unit vectors that share a term."""
    return a.select(left, "term", F.col("w").alias("wa")).join(b.select(right, "term", F.col("w").alias("wb")), "term").groupBy(left, right).agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def top(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best of each query with their rank from 1; ties by key, only scores above 0."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key))
    return scores.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], query: str, key: str) -> DataFrame:
    """Reciprocal rank fusion of ranked lists with weights."""
    parts = [ranked.select(query, key, (F.lit(w) / (RRF_K + F.col("rank"))).alias("part")) for ranked, w in lists]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    return all_parts.groupBy(query, key).agg(F.sum("part").alias("score"))


def metrics(found: DataFrame, golden: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Hit@k, MRR and nDCG@k over all golden queries; an absent document counts 0."""
    rank = F.when(F.col("rank") <= k, F.col("rank"))
    joined = golden.join(found, [query, key], "left").withColumn("r", rank)
    return joined.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("r").isNotNull().cast("int")), 6).alias("hit"),
        F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce(1 / F.log2(F.col("r") + 1), F.lit(0.0))), 6).alias("ndcg"),
    )


def nearest(vectors: DataFrame, asked: DataFrame, key: str, vector: str, query: str, k: int, block: int = 20_000) -> DataFrame:
    """The k nearest rows by cosine of each asked vector, itself left out: query, key, rank, score.

    Exact: ``asked`` (the query set) is taken in blocks of about ``block`` rows; a task multiplies its rows with a block
    and keeps k of them for each query. Equal scores (to nine digits) stand by key. Zero vectors have no neighbours.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-asked.count() // block))
    numbered = asked.select(F.col(key).cast("long").alias("id"), vector, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    schema = pa.schema([(query, pa.int64()), (key, pa.int64()), ("score", pa.float64())])
    found = spark.createDataFrame([], f"{query} long, {key} long, score double")
    for n in range(blocks):
        rows = numbered.filter(F.col("block") == n).select("id", vector).toArrow()  # at most about ``block`` rows
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), _normed(rows[vector].combine_chunks())))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked_ids, q = shared.value
            ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    own, v = part.column(0).to_numpy(), _normed(part.column(1))
                    s = np.round(q @ v.T, 9)
                    s[(asked_ids[:, None] == own[None, :]) | ~v.any(axis=1)[None, :] | ~q.any(axis=1)[:, None]] = -2
                    ids, scores = np.hstack([ids, np.broadcast_to(own, s.shape)]), np.hstack([scores, s])
                    order = np.lexsort((ids, -scores), axis=1)[:, :k]
                    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            kept = scores > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked_ids[:, None], ids.shape)[kept]), pa.array(ids[kept]), pa.array(scores[kept])], schema=schema)

        found = found.unionByName(vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(best, found.schema))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(query, key, "rank", "score")


def _normed(lists: pa.Array) -> np.ndarray:
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
