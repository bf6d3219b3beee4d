"""Bytes covered by a long string that occurs more than once in the corpus.

A full external suffix sort carries a tuple for every byte; README.md says why that does not fit here. What is kept
of it: suffixes are sampled by a rule that looks only at nearby bytes (as the leftmost-smallest positions of induced
sorting are), tuples are carried for the samples, the samples' verdict is passed on to all suffixes between them,
and only where samples disagree is a finer level entered, whose tuples are single suffixes.

Level 1: each window of LENGTH bytes takes the position of its smallest K-byte hash as its anchor, so equal windows
have equal anchors. An anchor's span is the union of its windows. Spans are grouped by the anchor's own K bytes: one
that stands alone has no repeated window; equal spans repeat in all their windows.
Level 2: spans that share an anchor but differ are opened: their windows are compared one by one, in a task where
few spans share the anchor, else as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.storage import written

LENGTH, K, SEGMENT = 200, 32, 1 << 20
#: Keys with at most so many different spans are compared inside one task.
SMALL, CELL = 2000, 8
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


_tables: list[np.ndarray] = []


def _tabled() -> list[np.ndarray]:
    """Random values of the bytes, powers of BASE and of its inverse modulo 2**64."""
    if not _tables:
        values = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
        _tables.extend((values, _powers(BASE, SEGMENT), _powers(pow(BASE, -1, 2**64), SEGMENT)))
    return _tables


def window_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes of at most SEGMENT bytes."""
    values, up, down = _tabled()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(raw) - k + 1]
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def anchors(raw: bytes, length: int = LENGTH, k: int = K) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, span's hash, first window, last window, anchor's place from the first window) of each anchor; the windows of all anchors are all windows."""
    width, bits = length - k + 1, np.uint64(SEGMENT - 1)
    for begin in range(0, len(raw) - length + 1, SEGMENT - length + 1):
        part = raw[begin : begin + SEGMENT]
        h = window_hashes(np.frombuffer(part, np.uint8), k)
        # among equal hashes the rightmost is taken
        ranked = (h & ~bits) | (bits - np.arange(len(h), dtype=np.uint64))
        n = len(part) - length + 1
        blocks = np.full(-(-len(ranked) // width) * width, 2**64 - 1, np.uint64)
        blocks[: len(ranked)] = ranked
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (bits - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], n) - 1
        keys = h[at[first]].view(np.int64).tolist()
        for key, s, e, a in zip(keys, first.tolist(), last.tolist(), at[first].tolist(), strict=True):
            yield key, xxhash.xxh3_64_intdigest(part[s : e + length] + b"%d" % (a - s)) - 2**63, begin + s, begin + e, a - s


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the row's key: doc (the id, or a hash of the text where that is null) and sig.

    Rows that share a doc_id are told apart by sig, a 64-bit hash of their text, rows without one by 128 bits.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns(_key())


def _key(prefix: str = "") -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {f"{prefix}doc": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text, F.lit("no id"))), f"{prefix}sig": F.xxhash64(text)}


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, sig (of _keyed), begin, end: byte ranges whose union is all that repeated windows cover."""
    keyed = _keyed(docs)
    fields = "doc long, sig long, key long, span long, first int, last int, anchor int"
    schema = pa.schema([("doc", pa.int64()), ("sig", pa.int64()), ("key", pa.int64()), ("span", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("anchor", pa.int32())])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in slices(batches, ("doc", "sig", "text")):
            yield record(schema, [(doc, sig, *a) for doc, sig, text in zip(*found, strict=True) for a in anchors(text.encode(), length)])

    spans = written(keyed.filter(F.octet_length("text") >= length).mapInArrow(sample, fields), "spans")
    # grouped results are written before they are joined back, so that the join can split a key of many spans
    shared = written(spans.groupBy("key").agg(F.count("*").alias("n"), (F.min("span") < F.max("span")).alias("differ")).filter("n > 1").select("key", "differ"), "shared-keys")
    kept = written(spans.join(shared, "key"), "shared-spans")
    # a span of each kind stands for the others; tuples of equal spans are counted, not gathered
    kinds = kept.filter("differ").groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "sig", "first", "last", "anchor")).alias("one"))
    kinds = written(kinds.select("key", "span", "n", "one.*"), "kinds")
    whole = kept.filter("not differ").select("doc", "sig", "first", "last").unionByName(kept.filter("differ").join(kinds.filter("n > 1").select("key", "span"), ["key", "span"], "left_semi").select("doc", "sig", "first", "last"))
    # the bytes of each kind's span, from its text
    sizes = written(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "kinds-of-keys")
    opened = kinds.join(sizes, "key").groupBy("doc", "sig").agg(F.collect_list(F.struct("key", "kinds", "first", "last", "anchor", (F.col("n") == 1).alias("alone"))).alias("open"))  # bounded by the document's length
    spans_of = pa.schema([("key", pa.int64()), ("kinds", pa.int64()), ("alone", pa.bool_()), ("doc", pa.int64()), ("sig", pa.int64()), ("first", pa.int32()), ("anchor", pa.int32()), ("bytes", pa.binary())])

    def open_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in slices(batches, ("doc", "sig", "text", "open"), 64):
            rows = []
            for doc, sig, text, listed in zip(*found, strict=True):
                raw = text.encode()
                rows += [(o["key"], o["kinds"], o["alone"], doc, sig, o["first"], o["anchor"], raw[o["first"] : o["last"] + length]) for o in listed]
            yield record(spans_of, rows)

    texts = keyed.join(opened, ["doc", "sig"]).dropDuplicates(["doc", "sig"])
    contents = written(texts.mapInArrow(open_spans, "key long, kinds long, alone boolean, doc long, sig long, first int, anchor int, bytes binary"), "contents")
    return whole.select("doc", "sig", F.col("first").alias("begin"), (F.col("last") + length).alias("end")).unionByName(_in_small(contents.filter(F.col("kinds") <= SMALL), length)).unionByName(_in_large(contents.filter(F.col("kinds") > SMALL), length))


def runs(flags: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the flagged windows, of which the first begins at ``first``."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > 1)
    return [(first + int(at[a]), first + int(at[b]) + length) for a, b in zip([0, *(gaps + 1)], [*gaps, len(at) - 1], strict=True)]


RANGE = "doc long, sig long, begin int, end int"


def _in_small(contents: DataFrame, length: int) -> DataFrame:
    """Keys of at most SMALL kinds: their spans meet in one task, many keys at a time, and windows are compared there."""
    out = pa.schema([("doc", pa.int64()), ("sig", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            hashes = [window_hashes(np.frombuffer(r[5], np.uint8), length) ^ np.uint64(r[0] & (2**64 - 1)) for r in rows]
            _, which, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            twice, found, at = n[which] > 1, [], 0
            for (_, alone, doc, sig, first, _), h in zip(rows, hashes, strict=True):
                if alone:
                    found += [(doc, sig, a, b) for a, b in runs(twice[at : at + len(h)], first, length)]
                at += len(h)
            return record(out, found)

        for found in slices(batches, ("key", "alone", "doc", "sig", "first", "bytes"), 1024):
            held += zip(*found, strict=True)
            if len(held) > 2 * SMALL:
                cut = len(held) - 1
                while held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                yield settle(held[:cut])
                held = held[cut:]
        if held:
            yield settle(held)

    return contents.repartition("key").sortWithinPartitions("key").mapInArrow(compare, RANGE)


def _in_large(contents: DataFrame, length: int) -> DataFrame:
    """Keys of more kinds: runs of CELL windows, dealt by where the anchor stands in them, become rows.

    The bytes that all windows of a run would share make its key. A run that is alone with them has no repeated
    window, equal runs repeat in all theirs, and only where runs differ does each window become a row. Rows are
    counted by content; no group is gathered.
    """
    runs_of = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("alone", pa.bool_()), ("doc", pa.int64()), ("sig", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in slices(batches, ("key", "alone", "doc", "sig", "first", "anchor", "bytes"), 128):
            rows = []
            for key, alone, doc, sig, first, anchor, raw in zip(*found, strict=True):
                n = len(raw) - length + 1
                at = 0
                while at < n:
                    cell = (anchor - at) // CELL  # offsets cell * CELL .. cell * CELL + CELL - 1 of the anchor
                    end = min(n, anchor - cell * CELL + 1)
                    shared = raw[max(0, anchor - cell * CELL) : anchor - cell * CELL - CELL + 1 + length]
                    part = raw[at : end + length - 1]
                    rows.append((xxhash.xxh3_64_intdigest(b"%d %d " % (key, cell) + shared) - 2**63, xxhash.xxh3_64_intdigest(part) - 2**63, alone, doc, sig, first + at, part))
                    at = end
            yield record(runs_of, rows)

    cells = written(contents.mapInArrow(deal, "key long, content long, alone boolean, doc long, sig long, first int, bytes binary"), "cells")
    facts = written(cells.groupBy("key").agg(F.count("*").alias("n"), (F.min("content") < F.max("content")).alias("differ")).filter("n > 1").select("key", "differ"), "shared-cells")
    met = written(cells.join(facts, "key"), "met-cells")
    whole = met.filter("alone and not differ").select("doc", "sig", F.col("first").alias("begin"), (F.col("first") + F.octet_length("bytes")).alias("end"))
    wide = pa.schema([("key", pa.int64()), ("alone", pa.bool_()), ("doc", pa.int64()), ("sig", pa.int64()), ("at", pa.int32()), ("content", pa.int64())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in slices(batches, ("key", "alone", "doc", "sig", "first", "bytes"), 256):
            rows = []
            for key, alone, doc, sig, first, raw in zip(*found, strict=True):
                h = window_hashes(np.frombuffer(raw, np.uint8), length).view(np.int64).tolist()
                rows += [(key, alone, doc, sig, first + i, x) for i, x in enumerate(h)]
            yield record(wide, rows)

    single = written(met.filter("differ").mapInArrow(explode, "key long, alone boolean, doc long, sig long, at int, content long"), "windows")
    twice = written(single.groupBy("key", "content").agg(F.count("*").alias("n")).filter("n > 1").select("key", "content"), "repeated-windows")
    return whole.unionByName(single.filter("alone").join(twice, ["key", "content"], "left_semi").select("doc", "sig", F.col("at").alias("begin"), (F.col("at") + length).alias("end")))


def cut(raw: bytes, ranges: list) -> tuple[bytes, int, int]:
    """What is left without the union of the ranges, bytes removed, and maximal runs removed."""
    kept, at, removed, runs, covered = [], 0, 0, 0, -1
    for r in sorted(ranges, key=lambda r: (r["begin"], r["end"])):
        begin, end = r["begin"], r["end"]
        if begin > covered:
            kept.append(raw[at:begin])
            runs += 1
            removed += end - begin
            covered = at = end
        elif end > covered:
            removed += end - covered
            covered = at = end
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    A null text is empty; texts shorter than ``length`` bytes lose nothing. Every copy of a repeated string goes.
    Rows that are repeated whole count as documents of their own, so their texts go from ``length`` bytes up; rows
    with a null doc_id are documents too. Other columns are ignored.
    """
    keyed = _keyed(docs)
    ranges = repeated_ranges(docs, length).groupBy("doc", "sig").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))  # bounded by the document's length
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in slices(batches, ("doc_id", "text", "ranges"), 64):
            rows = []
            for doc_id, text, listed in zip(*found, strict=True):
                raw = text.encode()
                kept, removed, runs = cut(raw, listed or [])
                rows.append((doc_id, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield record(schema, rows)

    return keyed.join(ranges, ["doc", "sig"], "left").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows, with all their columns, text and n_chars (where there is one) as they are without repeated bytes.

    Characters that a cut leaves incomplete go too. A row that loses all but white space goes; a row that loses
    nothing stays as it is.
    """
    keyed = docs.withColumns(_key("__"))
    ranges = repeated_ranges(docs, length).groupBy(F.col("doc").alias("__doc"), F.col("sig").alias("__sig")).agg(F.collect_list(F.struct("begin", "end")).alias("__ranges"))
    names, n_chars = docs.columns, docs.schema["n_chars"].dataType.simpleString() if "n_chars" in docs.columns else None

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, listed = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "__ranges"))
                left = [cut(t.encode(), r)[0].decode(errors="ignore") if r else t for t, r in zip(texts, listed, strict=True)]
                part = part.select(names)
                part = part.set_column(names.index("text"), part.schema.field("text"), pa.array(left, part.schema.field("text").type))
                if n_chars:
                    field, i = part.schema.field("n_chars"), names.index("n_chars")
                    own = part.column(i).to_pylist()
                    part = part.set_column(i, field, pa.array([len(t) if r else n for t, r, n in zip(left, listed, own, strict=True)], field.type))
                yield part.filter(pa.array([not r or bool(t.strip()) for t, r in zip(left, listed, strict=True)], pa.bool_()))

    return keyed.join(ranges, ["__doc", "__sig"], "left").select(*names, "__ranges").mapInArrow(remove, docs.schema)
