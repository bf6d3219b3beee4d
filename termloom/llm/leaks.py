"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of words under TF-IDF: frequencies of hashed words, features by a shorter hash. A randomised SVD, one
pass over the passages in which tasks add up their part of the product with a random matrix, gives a latent space.
Benchmark items, a stated query set taken in blocks, are compared by cosine with every window of every document. A window
and an item of at least COSINE are candidates; they are checked by the longest common subsequence of words and by
whether the item's last sentence (its answer) stands in the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.storage import written
from termloom.llm.word_hashes import hashes_of, signs_of

WORD = re.compile(r"\w+")
FEATURES, BLOCK, DIMENSIONS, EXTRA, BAND = 2048, 12, 96, 16, 64
PASSAGE = 5 * BLOCK
#: Counters of document frequencies. Inverse frequencies count to this power: function words say nothing of a passage.
COUNTERS, POWER = 1 << 18, 1.5
#: Windows of so many blocks; an item of n words is sought in the first that holds it whole wherever it begins.
SCALES = (3, 5, 7, *(12 << k for k in range(20)))
#: A window is a candidate for an item from this cosine. README.md has the share of windows and the recall at it.
COSINE = 0.38
#: Least share of an item's words in order, without and with its answer; least share of the answer.
ALONE, WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: Items in a block, and words whose vectors are made at a time.
ITEMS, AT_ONCE = 50_000, 16_000
KEPT = 400_000
#: Texts are hashed together up to so many characters; a longer one is taken word by word.
CHARACTERS = 1 << 20
#: Longer texts are searched in parts of so many words that overlap by the widest window.
PART = 8192 * BLOCK


class Hashes(dict):
    """Hashes of words; one that is not there is made."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


_words = Hashes()
_signs: np.ndarray | None = None


def forget() -> None:
    """Keep the words that were met first, which are the frequent ones; tasks do so when they end, as other operators use the same workers."""
    global _words
    _words = Hashes(islice(_words.items(), KEPT // 4))


def hashed(text: str | None) -> np.ndarray:
    """A 32-bit hash of each word in lower case."""
    found = WORD.findall((text or "").lower())
    if len(_words) > KEPT:
        forget()
    return np.fromiter(map(_words.__getitem__, found), np.uint32, len(found))


def hashed_all(texts: list[str | None]) -> Iterator[np.ndarray]:
    """What ``hashed`` gives for each text, made for many texts at a time."""
    global _signs
    if _signs is None:
        _signs = signs_of(WORD)
    held, size = [], 0
    for text in texts:
        small = (text or "").lower()
        if held and size + len(small) > CHARACTERS:
            yield from hashes_of(held, _signs)
            held, size = [], 0
        if len(small) > CHARACTERS:
            yield hashed(text)
        else:
            held.append(small)
            size += len(small)
    if held:
        yield from hashes_of(held, _signs)


def feature(words: np.ndarray) -> np.ndarray:
    return (words & np.uint32(FEATURES - 1)).astype(np.int64)


def counter(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint32(12)) & np.uint32(COUNTERS - 1)).astype(np.int64)


def weight(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The inverse frequency of each word with a random sign."""
    return idf[counter(words)] * (1 - 2 * (words >> np.uint32(31)).astype(np.float32))


def scale_of(n_words: int) -> int:
    return next((i for i, s in enumerate(SCALES) if n_words <= (s - 1) * BLOCK), len(SCALES) - 1)


def word_table(docs: DataFrame) -> DataFrame:
    """doc, words: hashed words, 4 bytes each; documents without words are left out."""
    schema = pa.schema([("doc", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, ("doc_id", "text")):
            yield record(schema, [(d, h.tobytes()) for d, h in zip(ids, hashed_all(texts), strict=True) if len(h)])
        forget()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc long, words binary"), "word-hashes")


def inverse_frequencies(table: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the counter)) to the power, for each counter, over all documents."""
    schema = pa.schema([("counter", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, last = np.zeros(COUNTERS + 1, np.int64), np.zeros(COUNTERS, np.int64)
        for (rows,) in slices(batches, ("words",)):
            for raw in rows:
                own = counter(np.frombuffer(raw, np.uint32))
                place = np.arange(len(own))
                last[own] = place
                totals[own[last[own] == place]] += 1  # once for each document
            totals[COUNTERS] += len(rows)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at])], schema=schema)

    found = table.mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS + 1 rows
    n = np.zeros(COUNTERS + 1)
    n[found["counter"].to_numpy()] = found["n"].to_numpy()
    return (np.maximum(np.log((1 + n[COUNTERS]) / (1 + n[:COUNTERS])), 0.05) ** POWER).astype(np.float32)


def latent_space(table: DataFrame, idf: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """FEATURES x dimensions: the leading right singular vectors of the passages' unit TF-IDF rows, each scaled to unit variance.

    One pass: with A the rows and R a random matrix, tasks add up A'(A R); Nystroem's formula turns that product into
    eigenvectors of A'A.
    """
    shape = (FEATURES, dimensions + EXTRA)
    random = np.random.default_rng(5).standard_normal(shape)
    shared = table.sparkSession.sparkContext.broadcast((idf, random.astype(np.float32)))  # of fixed size

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, r = shared.value
        total = np.zeros(shape)

        def add(rows: list[np.ndarray]) -> None:
            words, sizes = np.concatenate(rows), np.array([len(x) for x in rows])
            passages = -(-sizes // PASSAGE)
            of = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            of = of // PASSAGE + np.repeat(np.cumsum(passages) - passages, sizes)
            n = int(passages.sum())
            a = np.zeros((n, FEATURES), np.float32)
            np.add.at(a.reshape(-1), of * FEATURES + feature(words), weight(words, idf))
            unscaled = a @ r  # rows of unit length would be divided by their norm here and in the second product
            total[:] += a.T @ (unscaled / np.maximum(np.einsum("ij,ij->i", a, a), 1e-18)[:, None])

        held, size = [], 0
        for (rows,) in slices(batches, ("words",)):
            for raw in rows:
                words = np.frombuffer(raw, np.uint32)
                for at in range(0, len(words), 100 * PASSAGE):  # a very long text is taken a hundred passages at a time
                    held.append(words[at : at + 100 * PASSAGE])
                    size += len(held[-1])
                    if size > 2 * AT_ONCE:
                        add(held)
                        held, size = [], 0
        if held:
            add(held)
        yield record(schema, [(b, total[b * BAND : (b + 1) * BAND].tobytes()) for b in range(FEATURES // BAND)])

    schema = pa.schema([("band", pa.int32()), ("part", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for found in slices(batches, ("band", "part"), 64):
            for band, raw in zip(*found, strict=True):
                sums[band] = sums.get(band, 0) + np.frombuffer(raw)
        yield record(schema, [(b, v.tobytes()) for b, v in sums.items()])

    fields = "band int, part binary"
    rows = table.mapInArrow(multiply, fields).repartition(FEATURES // BAND, "band").mapInArrow(add, fields).collect()  # FEATURES x dimensions numbers
    product = np.zeros(shape)
    for r in rows:
        product[r["band"] * BAND : (r["band"] + 1) * BAND] = np.frombuffer(r["part"]).reshape(BAND, -1)
    shift = 1e-9 * max(np.linalg.norm(product), 1e-9)
    core = random.T @ (product + shift * random)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max(initial=0) * 1e-5
    half = vectors[:, good] / np.sqrt(values[good])
    left, singular, _ = np.linalg.svd((product + shift * random) @ half, full_matrices=False)
    keep = singular > singular.max(initial=0) * 1e-2  # below is rounding, tasks multiply in single precision
    left, singular = left[:, keep][:, :dimensions], singular[keep][:dimensions]
    return (left / singular * singular.max(initial=1)).astype(np.float32)


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` with the item of ``masks`` (bit-parallel)."""
    full = (1 << size) - 1
    v = full
    for w in words:
        u = v & masks[w]
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def checked(window: list[int], item: dict) -> tuple[float, float]:
    """Shares of the item and of its answer that stand in the window, in order."""
    masks, n = item["masks"], item["n"]
    hits = [w for w in window if w in masks]
    if len(hits) < WITH_ANSWER * n:  # a window can hold no more of an item in order than words that the item has at all
        return 0.0, 0.0
    share = common(masks, n, hits) / n
    if share < WITH_ANSWER:
        return share, 0.0
    answer = [w for w in window if w in item["answer"]]
    return share, common(item["answer"], item["n_answer"], answer) / item["n_answer"]


def described(item_id: int | None, text: str | None) -> dict | None:
    words = hashed(text)
    if not len(words):
        return None
    last = [s for s in re.split(r"[.!?]+", text) if WORD.search(s)][-1]
    answer = hashed(last).tolist()
    return {"id": item_id, "words": words, "n": len(words), "masks": masks_of(words.tolist()), "answer": masks_of(answer), "n_answer": len(answer), "scale": scale_of(len(words))}


def vectors(words: np.ndarray, starts: np.ndarray, space: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The sums of the words' latent vectors from each start to the next, a few words at a time."""
    sizes = np.diff(np.append(starts, len(words)))
    wide = int(sizes.max())
    out, step = np.zeros((len(starts), space.shape[1]), np.float32), max(1, AT_ONCE // wide)
    f, w = feature(words), weight(words, idf)
    for at in range(0, len(starts), step):
        own = sizes[at : at + step, None] > np.arange(wide)
        place = np.where(own, starts[at : at + step, None] + np.arange(wide), 0)
        out[at : at + step] = (np.where(own, w[place], 0)[:, None, :] @ space.take(f[place], axis=0))[:, 0]
    return out


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def found_in(docs: list[np.ndarray], space: np.ndarray, idf: np.ndarray, items: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, float, int]]:
    """Candidates (document, first block, scale, cosine, item's place) of documents that have words.

    ``items``: for each scale the unit vectors of its items and their places.
    """
    sizes = np.array([len(d) for d in docs])
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * BLOCK
    sums = np.zeros((len(starts) + 1, space.shape[1]), np.float32)
    np.cumsum(vectors(np.concatenate(docs), starts, space, idf), axis=0, out=sums[1:])
    for scale, (matrix, places) in items.items():
        width = np.minimum(SCALES[scale], blocks)
        count = blocks - width + 1
        doc = np.repeat(np.arange(len(docs)), count)
        block = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        for at in range(0, len(doc), AT_ONCE // 4):
            own, begin = doc[at : at + AT_ONCE // 4], block[at : at + AT_ONCE // 4]
            low = first[own] + begin
            z = sums[low + width[own]] - sums[low]
            norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]
            for j in range(0, len(places), 4000):
                near = z @ matrix[j : j + 4000].T
                near /= norms
                i, k = np.nonzero(near >= COSINE)
                yield from zip(own[i].tolist(), begin[i].tolist(), repeat(scale), near[i, k].tolist(), places[j + k].tolist(), strict=False)


def search(table: DataFrame, items: list[tuple], space: np.ndarray, idf: np.ndarray) -> DataFrame:
    """doc, item_id, cosine, share, answer of the best window of each document and item that pass the checks.

    ``items``: id, text.
    """
    own = [(i, t, w) for i, t in items if len(w := hashed(t))]
    shared = table.sparkSession.sparkContext.broadcast((own, space, idf))  # at most ITEMS items, a matrix and counters of fixed size
    schema = pa.schema([("doc", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space, idf = shared.value
        sizes = np.array([len(w) for *_, w in items])
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * BLOCK
        z = unit(np.add.reduceat(vectors(np.concatenate([w for *_, w in items]), starts, space, idf), first, axis=0))
        scale = np.array([scale_of(len(w)) for *_, w in items])
        by_scale = {int(s): (z[scale == s], np.flatnonzero(scale == s)) for s in np.unique(scale)}
        overlap = SCALES[int(scale.max())] * BLOCK
        known: dict[int, dict] = {}  # items that have been candidates, as the checks need them
        for ids, raws in slices(batches, ("doc", "words"), 64):
            parts, best = [], {}
            for d, raw in enumerate(raws):
                words = np.frombuffer(raw, np.uint32)
                for at in range(0, max(1, len(words) - overlap), PART):
                    parts.append((d, words[at : at + PART + overlap]))
            lists: dict[int, list[int]] = {}
            for i, block, s, cosine, k in found_in([w for _, w in parts], space, idf, by_scale):
                d = parts[i][0]
                if i not in lists:
                    lists[i] = parts[i][1].tolist()
                if k not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[k] = described(*items[k][:2])
                share, answer = checked(lists[i][block * BLOCK : (block + SCALES[s]) * BLOCK], known[k])
                if (share >= ALONE or share >= WITH_ANSWER and answer >= ANSWER) and (share, answer) > best.get((d, k), (0, 0, 0))[:2]:
                    best[d, k] = (share, answer, cosine)
            yield record(schema, [(ids[d], items[k][0], round(c, 4), round(s, 4), round(a, 4)) for (d, k), (s, a, c) in best.items()])

    return table.mapInArrow(run, "doc long, item_id long, cosine double, share double, answer double")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that leaks into it: doc_id, item_id, cosine, share, answer.

    Documents and items without words (null, empty) have no rows. Rows of a doc_id that occurs more than once count
    as its passages, and so do the rows with a null doc_id; of items with equal texts, each has its row, and repeated
    rows of an item count once.
    """
    spark = docs.sparkSession
    table = word_table(docs)
    idf = inverse_frequencies(table)
    space = latent_space(table, idf)
    queries = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    blocks = max(1, -(-queries.count() // (ITEMS * 4 // 5)))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = spark.createDataFrame([], "doc long, item_id long, cosine double, share double, answer double")
    for b in range(blocks):
        items = [(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == b).collect() if WORD.search(r["text"])]
        if items:
            found = found.unionByName(search(table, items, space, idf))
    return found.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(F.max(F.struct("share", "answer", "cosine")).alias("best")).select("doc_id", "item_id", "best.cosine", "best.share", "best.answer")
