"""Packing along a space-filling curve.

A document's token ids are hashed into a sparse vector and projected to three dimensions; the Hilbert key of the
point orders the documents, so that neighbours are alike. The ids of all documents, laid end to end in that order, are
cut into sequences; only the very last sequence can have room left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.bpe import encoder
from termloom.llm.running import running_total
from termloom.llm.storage import written

LENGTH, END = 1024, 0
DIMENSIONS, BITS, FEATURES = 3, 16, 1 << 14

_projections: list[np.ndarray] = []


def points(texts: list[np.ndarray]) -> np.ndarray:
    """For each text's ids DIMENSIONS integers of BITS bits, from its hashed, log-weighted counts of ids."""
    if not _projections:
        _projections.append(np.random.default_rng(11).standard_normal((FEATURES, DIMENSIONS)))
    sizes = np.array([len(ids) for ids in texts])
    feature = ((np.concatenate(texts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
    seen, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * FEATURES + feature, return_counts=True)
    text, weight, rows = seen // FEATURES, 1.0 + np.log(counts), _projections[0][seen % FEATURES]
    norm = np.sqrt(np.bincount(text, weight**2, len(texts)))
    v = np.stack([np.bincount(text, weight * rows[:, k], len(texts)) for k in range(DIMENSIONS)], axis=1) / np.maximum(norm, 1e-12)[:, None]
    return (1 / (1 + np.exp(-np.clip(v, -30, 30))) * (2**BITS - 1)).astype(np.int64)


def hilbert(x: list, bits: int = BITS):
    """The place of a point on the Hilbert curve (Skilling's transform); coordinates may be arrays, one entry a point."""
    x, n = [np.asarray(v, np.int64) for v in x], len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            high, t = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            first = x[0] ^ np.where(high, q - 1, t)
            if i:
                x[i] = x[i] ^ np.where(high, 0, t)
            x[0] = first
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = t ^ np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b) & 1
    return key if np.ndim(key) else int(key)


def ordered_ids(docs: DataFrame, tokenizer: str, end_id: int = END) -> DataFrame:
    """doc_id, n_tokens, ids, and the number of ids before each document in curve order.

    Ties on the curve stand by doc_id (null first), then by a 128-bit hash of the ids; rows that are wholly equal are
    interchangeable. Only keys and lengths are range-sorted; ids are written once and joined by row.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("mark", pa.binary()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        end = np.array([end_id], enc.dtype).tobytes()
        for doc_ids, texts in slices(batches, ("doc_id", "text")):
            coded = enc.ids([t or "" for t in texts])
            curve = hilbert(list(points([np.frombuffer(raw, enc.dtype) for raw in coded]).T)).tolist()
            yield record(schema, [(d, c, xxhash.xxh3_128_digest(raw), len(raw) // enc.dtype.itemsize + 1, raw + end) for d, c, raw in zip(doc_ids, curve, coded, strict=True)])
        enc.trim()

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, curve long, mark binary, n_tokens long, ids binary")
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    places = running_total(coded.select("row", "curve", "doc_id", "mark", "n_tokens"), [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.col("mark")], "n_tokens", "before")
    return coded.select("row", "doc_id", "n_tokens", "ids").join(places.select("row", "before"), "row")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END) -> DataFrame:
    """doc_id, text -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary).

    A null text is empty and has the end id alone. Sequences are filled without gaps in the order of the curve;
    only the last may be shorter than ``length``.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, schema = encoder(tokenizer).dtype, pa.schema(fields)
        for found in slices(batches, ("doc_id", "n_tokens", "ids", "before"), 64):
            rows = []
            for doc_id, n, raw, before in zip(*found, strict=True):
                ids = np.frombuffer(raw, dtype)
                for sequence in range(before // length, (before + n - 1) // length + 1):
                    a, b = max(before, sequence * length), min(before + n, (sequence + 1) * length)
                    piece = ids[a - before : b - before].astype("<u4").tobytes()
                    rows.append((doc_id, a - before, b - a, zlib.crc32(piece), n, sequence, a - sequence * length, piece))
            yield record(schema, rows)

    return ordered_ids(docs, tokenizer, end_id).select("doc_id", "n_tokens", "ids", "before").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
