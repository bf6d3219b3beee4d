"""Near duplicates by DartMinHash signatures of weighted five-word shingles.

A weighted set is a region of the plane: each element is as wide as its weight. Darts fall on the plane at a rate
of one a unit cell, their places decided by hashes of element and cell alone, so two sets see the same darts where
their regions overlap. A dart has a rank (its height) and one of K coordinates; a coordinate's value is its lowest
dart. As many darts are thrown as fill all coordinates almost surely; a set with an empty coordinate throws twice
as many. Equal values at a coordinate have the weighted Jaccard similarity as probability.

Texts are similar by weighted or by plain shingles (each of weight 1), so those with repeated shingles have a
signature of each kind. Signatures are cut into bands. A bucket has three centres: the member that shares most buckets
with others and two that a hash chooses. Every member is compared with the centre of most of its buckets, then with
those of its other centres that are still in another component. Members that are in different components after that
are compared in blocks of a bucket, each pair in one of its buckets only. Two bits of each coordinate say
inside the join whether a pair can be similar at all; every link is then checked on the shingles themselves.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.components import components
from termloom.llm.storage import discard, written

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 40, 6
K = BANDS * ROWS
#: Darts that a set throws at first: K coordinates are all filled, but for one set in twenty.
DARTS = K * np.log(K) + 3 * K
#: Members of a bucket are compared in blocks of about so many, so that a large bucket is many tasks' work.
BLOCK = 2000
#: Two bits of each coordinate are kept, in PLANES longs a bit. Sets at the threshold differ in 36 of 240 coordinates with
#: a deviation of 5.5; pairs that differ in more than three deviations above that are no candidates. One pair in 750
#: right at the threshold is lost so, and practically none from 0.82 on (tests/llm/test_recall.py measures it).
PLANES = -(-K // 64)
DIFFER = int(0.75 * (1 - SIMILAR) * K + 3 * (K * 0.75 * (1 - SIMILAR) * (1 - 0.75 * (1 - SIMILAR))) ** 0.5)
WORD = re.compile(r"\w+")
M1, M2, M3, M4 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x5851F42D4C957F2D)
#: P(at most n darts in a cell) for rate 1, as 64-bit thresholds.
POISSON = np.array([min(2**64 - 1, int(p * 2**64)) for p in np.cumsum([np.exp(-1) / np.prod(np.arange(1, n + 1), dtype=float) for n in range(12)])], np.uint64)

WORDS_KEPT = 300_000
#: Shingles (16 bytes each) of texts that a task remembers while it checks pairs.
SETS_KEPT = 2_000_000
_words: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x + M1
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def forget() -> None:
    """Keep the words that were met first, which are the frequent ones; tasks do so when they end, as other operators use the same workers."""
    global _words
    _words = dict(islice(_words.items(), WORDS_KEPT // 4))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct five-word shingles and how often each occurs; fewer words make one shingle."""
    return shingled(words_of(text))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingled(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(_words) > WORDS_KEPT:
        forget()
    for w in set(found).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w.encode())
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - SHINGLE + 1)
    key = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        key = mix(key ^ h[k : k + n])
    return np.unique(key, return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight grows with the logarithm of its count, so that repeated lines do not outweigh the rest."""
    return 1.0 + np.log(counts)


def sketch(elements: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The K values of a weighted set that isn't empty."""
    total, darts = float(weight.sum()), float(DARTS)
    while True:
        high = darts / total  # ranks below this: about ``darts`` darts in all
        wide, tall = np.ceil(weight).astype(np.int64), int(np.ceil(high))
        whole = not (weight != 1).any()
        if whole:
            cell = mix(elements ^ mix(np.zeros(1, np.uint64)))
        else:
            element = np.repeat(elements, wide)
            column = np.arange(len(element)) - np.repeat(np.cumsum(wide) - wide, wide)
            limit = np.repeat(np.repeat(weight, wide) - column, tall)  # of the element's region in this cell
            cell = mix(element ^ mix(column.astype(np.uint64)))
        row = np.tile(np.arange(tall), len(cell))
        cell = mix((cell[:, None] + np.arange(tall, dtype=np.uint64)[None, :] * M2).ravel())
        # a cell's hash says how many darts it holds
        count = np.searchsorted(POISSON, cell)
        at = np.repeat(np.arange(len(cell)), count)
        k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(cell[at] ^ ((k + 1).astype(np.uint64) * M4))
        if whole:  # each cell lies in its element's region
            rank = row[at] + unit(mix(dart ^ M3))
            hit = rank < high
        else:
            hit = unit(dart) < limit[at]
            dart, at = dart[hit], at[hit]
            rank = row[at] + unit(mix(dart ^ M3))
            hit = rank < high
        dart, rank = dart[hit], rank[hit]
        coordinate = mix(dart ^ M2) % np.uint64(K)
        order = np.argsort((coordinate << np.uint64(55)) | (rank * (2.0**54 / high)).astype(np.uint64))
        sorted_by = coordinate[order]
        first = order[np.concatenate([[True], sorted_by[1:] != sorted_by[:-1]])] if len(order) else order
        if len(first) == K:
            return dart[first]
        darts *= 2


def bands(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the bands, and two bits of each coordinate packed into 64-bit words, of the weighted set and of the plain one.

    A text without words has no keys. Where no shingle repeats, both sets are the same and the plain one's bits are left out.
    """
    return banded(*shingles(text))


def banded(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """See bands, of a text's shingles."""
    if not len(elements):
        return np.zeros(0, np.uint64), np.zeros(2 * PLANES, np.uint64), np.zeros(0, np.uint64)
    key, bits = _signed(sketch(elements, weights(counts)))
    if counts.max() == 1:
        return key, bits, np.zeros(0, np.uint64)
    plain_key, plain_bits = _signed(sketch(elements, np.ones(len(elements))))
    return np.concatenate([key, plain_key]), bits, plain_bits


def _signed(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band, and the packed bits."""
    planes = np.zeros((2, 64 * PLANES), np.uint8)
    planes[0, :K], planes[1, :K] = signature & np.uint64(1), (signature >> np.uint64(1)) & np.uint64(1)
    key, signature = np.arange(BANDS, dtype=np.uint64), signature.reshape(BANDS, ROWS)
    for r in range(ROWS):
        key = mix(key ^ signature[:, r])
    return key, np.packbits(planes).view(np.uint64)


def _close(a: Column, b: Column) -> Column:
    """Whether the bits of two texts (weighted, and plain where it differs) allow them to be similar by either measure."""
    plain = lambda x: F.when(F.size(x["plain"]) > 0, x["plain"]).otherwise(x["weighted"])
    return _agree(a["weighted"], b["weighted"]) | (((F.size(a["plain"]) > 0) | (F.size(b["plain"]) > 0)) & _agree(plain(a), plain(b)))


def _agree(a: Column, b: Column) -> Column:
    differ = [F.bit_count(a[i].bitwiseXOR(b[i]).bitwiseOR(a[PLANES + i].bitwiseXOR(b[PLANES + i]))) for i in range(PLANES)]
    return functools.reduce(operator.add, differ) <= DIFFER


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard similarities of the sets and of the weighted sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(common) / (len(a[0]) + len(b[0]) - len(common))
    wa, wb = weights(a[1]), weights(b[1])
    least = float(np.minimum(wa[i], wb[j]).sum())
    return max(plain, least / (float(wa.sum()) + float(wb.sum()) - least))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest (of the text, null as empty) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest("text").alias("digest"))


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _sketches(rows: DataFrame) -> DataFrame:
    """key (of the text's words, or of the text where it has none), digest, bands, bits."""
    schema = pa.schema([("key", pa.binary()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("weighted", pa.list_(pa.int64())), ("plain", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # copies in this task are sketched once
        for digests, texts in slices(batches, ("digest", "text")):
            out = []
            if len(done) > 500_000:
                done.clear()
            for own, text in zip(digests, texts, strict=True):
                if own in done:
                    continue
                done.add(own)
                found = words_of(text)
                key = xxhash.xxh3_128_digest((" ".join(found) if found else "\0" + (text or "")).encode())
                out.append((key, own, *(x.view(np.int64).tolist() for x in banded(*shingled(found)))))
            yield record(schema, out)
        forget()

    found = rows.select("digest", "text").mapInArrow(run, "key binary, digest binary, bands array<long>, weighted array<long>, plain array<long>")
    return found.select("key", "digest", "bands", F.struct("weighted", "plain").alias("bits"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a, b whose texts (node, text) are similar, checked on their shingles."""
    side = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))
    both = pairs.join(side("a", "ta"), "a").join(side("b", "tb"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # rows come by b; an a, often a centre, comes again and again
        size, last, kept = 0, None, None
        for found in slices(batches, ("a", "b", "ta", "tb"), 64):
            rows = []
            for a, b, ta, tb in zip(*found, strict=True):
                if last != b:
                    last, kept = b, shingles(tb)
                if a not in sets:
                    if size > SETS_KEPT:
                        sets, size = {}, 0
                    sets[a] = shingles(ta)
                    size += len(sets[a][0])
                s = similarity(sets[a], kept)
                if s >= SIMILAR:
                    rows.append((a, b, s))
            yield record(schema, rows)

    return both.mapInArrow(check, "a long, b long, similarity double").distinct()


def _labelled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of nodes with their component; a node without links is its own."""
    return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are in different components."""
    side = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _apart(members: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs a, b of nodes in different components that share a bucket and are close by their bits, each pair once.

    ``members``: bucket, node, component, bits; ``nodes``: node, bands. A bucket's members are dealt into blocks by a
    hash, and each pair of blocks is one key of the join, so no task holds more of a bucket than two blocks. A pair is
    taken in the smallest of the buckets it shares.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    cells = F.ceil(F.col("n") / block).cast("int")
    own = members.join(sizes.select("bucket", cells.alias("cells")), "bucket").join(nodes.select("node", "bands"), "node").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    own = written(own, "rest")
    side = lambda i: F.struct("node", "component", "bits", "bands").alias(i)
    left = own.select("bucket", F.col("cell").alias("low"), F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("high"), side("x"))
    right = own.select("bucket", F.explode(F.sequence(F.lit(0), F.col("cell"))).alias("low"), F.col("cell").alias("high"), side("y"))
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("bucket")
    # inside a block both orders of a pair meet, across blocks one
    met = left.join(right, ["bucket", "low", "high"]).filter(((F.col("low") < F.col("high")) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.component") != F.col("y.component")) & _close(F.col("x.bits"), F.col("y.bits")) & once)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _grouped(rows: DataFrame, ids: bool) -> tuple[DataFrame, DataFrame]:
    """Of rows (see _rows): digest -> node, and node -> component, join_links, for nodes with links.

    Texts with the same words are copies; without words, equal texts are (null as empty). Copies are one node, and one
    of their texts is compared with other nodes; join_links counts a node's links that
    were verified to join the group (see near_duplicates). With ``ids``, the nodes of
    rows that share a doc_id are in one component.
    """
    sketches = written(_sketches(rows), "sketches")
    nodes = written(sketches.groupBy("key").agg(F.first(F.struct("digest", "bands", "bits")).alias("own")).select("key", "own.*", F.monotonically_increasing_id().alias("node")), "nodes")
    places = written(sketches.select("key", "digest").distinct().join(nodes.select("key", "node"), "key").select("digest", "node"), "places")
    discard(sketches)
    joined, same = lambda links: links.select("a", "b"), None
    if ids:
        held = rows.select("doc_id", "digest").distinct().join(places, "digest").select("doc_id", "node").distinct()
        several = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a < top").select("doc_id", "a")
        same = written(held.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"), "same")
        joined = lambda links: links.select("a", "b").union(same)
    buckets = written(nodes.select("node", F.explode("bands").alias("bucket")).distinct(), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(buckets.join(shared, "bucket").join(nodes.select("node", "bits"), "node"), "members")
    own = nodes.select("node", "digest").join(members.select("node").distinct(), "node")
    texts = written(rows.groupBy("digest").agg(F.first("text").alias("text")).join(own, "digest").select("node", "text"), "texts")
    # an original shares more buckets with its copies than they do with each other: the best known member is the centre
    known = members.groupBy("node").agg(F.sum("n").alias("met"))
    # one hash for all buckets, so that buckets which share members draw the same centres and compare each pair once
    ranked = members.join(known, "node").select("bucket", F.struct("met", (-F.col("node")).alias("id"), "bits").alias("known"), F.struct(F.xxhash64("node").alias("h"), (-F.col("node")).alias("id"), "bits").alias("drawn"))
    chosen = ranked.groupBy("bucket").agg(F.max("known").alias("k"), F.max("drawn").alias("x"), F.min("drawn").alias("y"))
    centres = chosen.select("bucket", F.explode(F.array(*(F.struct((-F.col(c)["id"]).alias("id"), F.col(c)["bits"].alias("bits")) for c in "kxy"))).alias("centre")).select("bucket", F.col("centre.id").alias("centre"), F.col("centre.bits").alias("own"))
    near = members.join(centres, "bucket").filter((F.col("node") != F.col("centre")) & _close(F.col("bits"), F.col("own")))
    stars = written(near.groupBy("node", "centre").agg(F.count("*").alias("n")).select("node", "n", F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")), "stars")
    pairs = lambda t: t.select("a", "b").distinct()
    # each node meets the centre of most of its buckets; then, after each step, only pairs across components are left
    best = written(pairs(stars.groupBy("node").agg(F.max(F.struct("n", "a", "b")).alias("s")).select("s.*")), "stars")
    steps = [written(_verified(best, texts), "links")]
    parts = components(joined(steps[0]))
    for left in (lambda: _across(pairs(stars), parts).join(best, ["a", "b"], "left_anti"), lambda: _apart(_labelled(members, parts).select("bucket", "node", "bits", "component"), nodes).join(pairs(stars), ["a", "b"], "left_anti")):
        steps.append(written(_verified(left(), texts), "links"))
        if not steps[-1].isEmpty():
            parts = components(joined(functools.reduce(DataFrame.union, steps)))
    links = functools.reduce(DataFrame.union, steps)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("join_links"))
    parts = written(parts.join(degree, "node", "left"), "parts")
    discard(nodes, buckets, members, texts, stars, best, *steps, same)
    return places, parts


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a doc_id: doc_id, class_id (the smallest doc_id of its group) and join_links.

    join_links is the most verified links that any of its texts was joined to its group by. It isn't the number of
    similar texts: a text is compared with some centres, and pairs already in one component are not compared.

    Rows with a null doc_id are left out (keep_one judges them); rows that share a doc_id count as one document.
    """
    rows = _rows(docs).filter("doc_id is not null")
    places, parts = _grouped(rows, ids=True)
    held = rows.select("doc_id", "digest").distinct().join(places, "digest").select("doc_id", "node").distinct()
    low = held.groupBy("node").agg(F.min("doc_id").alias("low")).join(parts, "node", "left").select("node", "low", "join_links", F.coalesce("component", "node").alias("component"))
    named = low.join(low.groupBy("component").agg(F.min("low").alias("class_id")), "component").select("node", "class_id", "join_links")
    return held.join(named, "node").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max(F.coalesce("join_links", F.lit(0))).alias("join_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates one row, with all its columns: that of the smallest doc_id, a null one last.

    A row is known by doc_id, text and a hash of all its columns; of rows equal in these, one stays. Rows that share a
    doc_id are judged each by its own text.
    """
    places, parts = _grouped(_rows(docs), ids=False)
    who = ["__digest", "__null", "__id", "__row"]
    rows = docs.withColumns({"__digest": digest("text"), "__null": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__row": F.xxhash64(*docs.columns)})
    least = rows.groupBy("__digest").agg(F.min(F.struct("__null", "__id", "__row")).alias("least"))
    group = places.join(parts, "node", "left").select(F.col("digest").alias("__digest"), F.coalesce("component", "node").alias("group"))
    first = least.join(group, "__digest").groupBy("group").agg(F.min(F.struct("least.__null", "least.__id", "__digest", "least.__row")).alias("first")).select(*(f"first.{c}" for c in who))
    return rows.join(first, who, "left_semi").dropDuplicates(who).select(docs.columns)
