"""Token-ID files: concatenated ids with Elias-Fano coded document boundaries.

A file holds the ids of a range of documents one after another, then two Elias-Fano sequences, the documents'
ids (doc_id) and the places where their token ids begin, then a JSON footer. A boundary costs about
2 + log2(ids a document) bits; ``select`` finds the k-th one from samples of the upper bits, so neither writer
nor reader keeps a table of 64-bit offsets.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.bpe import encoder
from termloom.llm.storage import filesystem, new_dir, publish, shuffles_dropped

END, SAMPLE, BLOCK = 2, 256, 2048
#: Bytes of text that one file, and so one task, takes at most, about.
FILE_BYTES = 256 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0 up, in 2 + log2(largest / count) bits each, about."""

    def __init__(self, head: dict, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.samples = head["n"], head["width"], low, high, samples

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict, bytes]:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = np.packbits(((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        high, samples = np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4" if n == 0 or ones[-1] < 1 << 32 else "<u8")
        parts = [low.tobytes(), high.tobytes(), samples.tobytes()]
        return {"n": n, "width": width, "bytes": [len(p) for p in parts], "wide": samples.dtype.itemsize}, b"".join(parts)

    @staticmethod
    def decode(head: dict, raw: bytes) -> EliasFano:
        a, b, _ = head["bytes"]
        return EliasFano(head, raw[:a], raw[a : a + b], np.frombuffer(raw, f"<u{head['wide']}", offset=a + b))

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The values first, first + 1, ... (count of them)."""
        count = max(0, min(count, self.n - first))
        if not count:
            return np.zeros(0, np.int64)
        last = first + count - 1
        begin = int(self.samples[first // SAMPLE])
        after = last // SAMPLE + 1
        end = int(self.samples[after]) if after < len(self.samples) else len(self.high) * 8
        byte = begin // 8
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)[byte : end // 8 + 1], bitorder="little")) + byte * 8
        ones = ones[ones >= begin][first % SAMPLE :][:count]
        upper = ones - np.arange(first, first + count)
        if not self.width:
            return upper.astype(np.int64)
        at = first * self.width
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[at // 8 : ((last + 1) * self.width + 7) // 8], bitorder="little")
        bits = bits[at % 8 :][: count * self.width].reshape(count, self.width).astype(np.int64)
        return (upper.astype(np.int64) << self.width) + bits @ (1 << np.arange(self.width, dtype=np.int64))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END, files: int | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest, which is written last.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty and has the end id alone; null
    ids come first; rows that share a doc_id stand by a hash of their text, then by text, and may be split over files.
    Only files that the manifest names count: a task writes to a temporary name and renames, so a lost executor leaves
    no half file behind. There are as many files as shuffle partitions, more where they would pass FILE_BYTES of text.
    """
    spark = docs.sparkSession
    total = 0 if files else docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        store, root = filesystem(path)
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}.tok"
        ids, lengths, nulls, out = [], [], 0, None
        end = np.array([end_id], enc.dtype).tobytes()
        temporary = f"{root}/_temporary/{uuid.uuid4().hex}-{name}"
        for doc_ids, texts in slices(batches, ("doc_id", "text")):
            if out is None:
                store.create_dir(f"{root}/_temporary", recursive=True)
                out = store.open_output_stream(temporary)
            coded = enc.ids([t or "" for t in texts])
            out.write(b"".join(x for c in coded for x in (c, end)))
            nulls += sum(d is None for d in doc_ids)
            ids.append(np.array([d for d in doc_ids if d is not None], np.int64))
            lengths.append(np.array([len(c) // enc.dtype.itemsize + 1 for c in coded], np.int64))
        enc.trim()
        if out is None:
            return
        own, sizes = np.concatenate(ids), np.concatenate(lengths)
        base = int(own[0]) if len(own) else 0
        names = EliasFano.encode((own - base).astype(np.uint64))  # the difference of two int64 fits uint64
        bounds = EliasFano.encode(np.cumsum(sizes) - sizes)
        total = int(sizes.sum())
        foot = json.dumps({"format": 1, "dtype": enc.dtype.str, "n_ids": total, "null_ids": nulls, "base": base, "names": names[0], "bounds": bounds[0]}).encode()
        out.write(names[1] + bounds[1] + foot + len(foot).to_bytes(8, "little"))
        out.close()
        publish(store, temporary, f"{root}/{name}")
        size = total * enc.dtype.itemsize + len(names[1]) + len(bounds[1]) + len(foot) + 8
        yield record(schema, [(name, shard, len(sizes), total, size)])

    with shuffles_dropped(spark):
        ordered.mapInArrow(write, "file string, shard long, n_docs long, n_ids long, n_bytes long").write.parquet(f"{path}/manifest")
    return spark.read.schema("file string, shard long, n_docs long, n_ids long, n_bytes long").parquet(f"{path}/manifest")


class TokenFile:
    """Random access to one file: ``bounds`` and ``ids`` read only what is asked for."""

    def __init__(self, store, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        foot = json.loads(self.file.read_at(length, size - 8 - length))
        self.dtype, self.n_ids, self.null_ids, self.base = np.dtype(foot["dtype"]), foot["n_ids"], foot["null_ids"], foot["base"]
        a, b = sum(foot["names"]["bytes"]), sum(foot["bounds"]["bytes"])
        begin = self.n_ids * self.dtype.itemsize
        self.names = EliasFano.decode(foot["names"], self.file.read_at(a, begin))
        self.starts = EliasFano.decode(foot["bounds"], self.file.read_at(b, begin + a))

    def bounds(self, first: int, count: int) -> np.ndarray:
        """Where documents first, ..., first + count begin; the end of the last one closes the list."""
        found = self.starts.select(first, count + 1)
        return found if len(found) == count + 1 else np.append(found, self.n_ids)

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        nulls = max(0, min(count, self.null_ids - first))
        return [None] * nulls + (self.names.select(first + nulls - self.null_ids, count - nulls) + self.base).tolist()

    def ids(self, begin: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * w, begin * w), self.dtype)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files that the manifest names: doc_id, start, n_tokens, ids_crc32."""
    manifest = spark.read.schema("file string, shard long, n_docs long, n_ids long, n_bytes long").parquet(f"{path}/manifest")
    # a row for each file; a window in one partition sums no more than these
    before = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        for names, sizes, firsts in slices(batches, ("file", "n_docs", "first")):
            for name, n_docs, first in zip(names, sizes, firsts, strict=True):
                opened = TokenFile(store, f"{root}/{name}")
                for at in range(0, n_docs, BLOCK):
                    count = min(BLOCK, n_docs - at)
                    bounds, rows = opened.bounds(at, count).tolist(), []
                    for doc_id, a, b in zip(opened.doc_ids(at, count), bounds, bounds[1:], strict=False):
                        rows.append((doc_id, first + a, b - a, zlib.crc32(opened.ids(a, b).astype("<u4").tobytes())))
                    yield record(schema, rows)
                opened.file.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return before.select("file", "n_docs", "first").repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    """Write all documents to token files in the shared folder and read every document back."""
    path = new_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return read_token_files(docs.sparkSession, path)
