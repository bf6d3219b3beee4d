"""Exact Jaccard join of documents by their sets of four-word shingles, as a blocked sparse matrix product.

The matrix has a row for each distinct set and a column for each shingle; two rows link when their overlap is at least
85 % of their union. Bounds that follow from the sizes keep the product small, and none of them loses a link:

- A row of n shingles shares at least ceil(0.85 n) with a partner. Rows with more shingles of their own than that leaves
  go first. That is judged on a quarter of the columns, chosen by hash: shingles that no other row has in that quarter
  are missing in every partner.
- Of the columns a row shares, rarest first, a link needs one among all but the last ceil(0.85 n) - 1. Only these are
  multiplied. Overlap counted there, plus what may follow, must reach 0.85 / 1.85 of both sizes.

In each column every row meets three centres first. Columns that still join rows of different components are multiplied
in blocks of rows, each pair in its first common column only, and pairs below the bound are discarded there. What is left is
counted on the whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import record
from termloom.llm.components import components
from termloom.llm.minhash import digest, mix
from termloom.llm.storage import discard, written

WORDS, LINK = 4, 85
#: One column in so many is looked at before the others.
SAMPLE = 4
#: Rows of a column that are multiplied at a time, and bytes of text and shingles that a task handles at once.
BLOCK, AT_ONCE, GRAMS = 1000, 1 << 21, 1 << 20
#: Most bits of the mask of chosen texts; with more than a sixteenth as many texts it passes more of the others.
MASK = 1 << 25

_RANDOM = np.random.default_rng(1201)
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = (_RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: A random value for each byte, capitals as their small letters.
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
#: The bytes that part words.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse; those of a usual piece are kept."""
    global _powers
    if n <= len(_powers[0]):
        return _powers
    made = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))
    if n <= 2 * AT_ONCE:
        _powers = made
    return made


def words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word in bytes of texts that begin at ``cuts``, and where each begins. No word goes over a cut."""
    letter = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    begin = letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]]))
    end = letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * PLACE[0]), begin


def pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that are cut at white space."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + AT_ONCE)
        while to < len(raw) and not WHITE[raw[to]]:
            white = np.flatnonzero(WHITE[raw[to : to + 4096]])
            to = to + int(white[0]) if len(white) else min(len(raw), to + 4096)
        yield raw[at:to]
        at = to


def _sets(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of texts, each with ``count`` words from place ``first`` of ``h``."""
    full = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        full = mix(sum((h[k : len(h) - WORDS + 1 + k] * PLACE[k] for k in range(WORDS)), np.uint64(0)))
    out = []
    for at, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= WORDS:
            own = np.sort(full[at : at + n - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:  # the whole sequence; its length keeps it apart from shingles of more words
            out.append(mix((h[at : at + n] * PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(full[:0])
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes; empty for null and for texts without words."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        own, cuts = raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if len(own) <= AT_ONCE:
            h, begin = words(own, cuts[:-1])
            edges = np.searchsorted(begin, cuts)
        else:  # a single long text
            h = np.concatenate([words(p, np.zeros(1, np.int64))[0] for p in pieces(own)])
            edges = np.array([0, len(h)])
        yield from _sets(h, edges[:-1], np.diff(edges))
        at = to


def least(n: Column) -> Column:
    """What a set of n shares at least with a partner."""
    return F.ceil(n * LINK / F.lit(100))


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * LINK


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), key (of the set; null where empty), n, sample (shingles of the sampled columns, once a task)."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("sample", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            keys, sizes, samples = [], [], []
            for own in shingle_sets(batch.column(2)):
                key = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                if len(done) > 500_000:
                    done.clear()
                samples.append(None if key is None or key in done else own[own % np.uint64(SAMPLE) == 0].tobytes())
                keys.append(key)
                sizes.append(len(own))
                done.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(samples, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest binary, key binary, n long, sample binary")


def _shared(nodes: DataFrame) -> DataFrame:
    """node, shared: how many of its sampled shingles other nodes have, for nodes that share some.

    Shingles meet in buckets of their hash. What a task's own rows share is counted before, and goes into its bucket as one
    mark, so a shingle of very many rows is no more than a mark from each task there. The counts of each task then meet in
    buckets of nodes, where they are added.
    """
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * partitions

    def counted(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, n = np.unique(node, return_counts=True)
        return own, n.astype(np.int64)

    def groups(gram: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted shingles, their nodes, and whether each occurs more than once."""
        order = np.argsort(gram, kind="stable")
        gram, node = gram[order], node[order]
        same = gram[1:] == gram[:-1]
        return gram, node, np.concatenate([same, [False]]) | np.concatenate([[False], same])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("values", pa.binary())])
        held, size, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, turn
            if not size:
                return
            gram = np.concatenate([np.frombuffer(s, np.uint64) for _, s in held])
            node = np.repeat(np.array([i for i, _ in held], np.int64), [len(s) // 8 for _, s in held])
            held, size, turn = [], 0, turn + 1
            gram, node, several = groups(gram, node)
            out = [(-1 - turn % buckets, *(x.tobytes() for x in counted(node[several])))] if several.any() else []
            mark = several & np.concatenate([[True], gram[1:] != gram[:-1]])
            node[mark] = -1
            gram, node = gram[mark | ~several], node[mark | ~several]
            bucket = ((gram >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            gram, node, edges = gram[order], node[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            out += [(b, node[i:j].tobytes(), gram[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for node, sample in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((node, sample or b""))
                size += len(held[-1][1]) // 8
                if size >= GRAMS:
                    yield from flush()
        yield from flush()

    def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        return own, np.bincount(at, np.concatenate([x for _, x in found])).astype(np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary())])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        last, nodes, values, size = None, [], [], 0

        def bucket() -> None:
            nonlocal size
            if not nodes:
                return
            _, node, several = groups(np.concatenate(values), np.concatenate(nodes))
            found.append(counted(node[several & (node >= 0)]))
            size += len(found[-1][0])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            if size:
                own, n = added(found)
                order = np.argsort(own % partitions, kind="stable")
                own, n = own[order], n[order]
                edges = np.searchsorted(own % partitions, np.arange(partitions + 1))
                cells = [(b, own[i:j].tobytes(), n[i:j].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]
                yield record(schema, cells)
            found, size = [], 0

        for batch in batches:
            for b, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(n, np.int64)
                if b < 0:
                    found.append((n, np.frombuffer(v, np.int64)))
                    size += len(n)
                else:
                    if b != last:
                        bucket()
                        last, nodes, values = b, [], []
                    nodes.append(n)
                    values.append(np.frombuffer(v, np.uint64))
                if size >= 2 * GRAMS:
                    yield from flush()
        bucket()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("shared", pa.int64())])
        last, found = None, []
        for batch in batches:
            for b, own, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last and found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in added(found)], schema=schema)
                    found = []
                last = b
                found.append((np.frombuffer(own, np.int64), np.frombuffer(n, np.int64)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added(found)], schema=schema)

    dealt = nodes.select("node", "sample").mapInArrow(deal, "bucket int, nodes binary, values binary")
    met = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "bucket int, nodes binary, counts binary")
    return met.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "node long, shared long")


def _may_be_chosen(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows with the digest (``own``) of a chosen node and few others, so that the join after it does not shuffle all texts.

    A mask of fixed size at most, as words of 64 bits, is looked up; it never drops a chosen text.
    """
    bits = min(MASK, 1 << max(10, (16 * chosen.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    mask = chosen.groupBy(F.shiftright(place("digest"), 6).alias("word")).agg(F.bit_or(bit("digest")).alias("bits"))
    return rows.join(F.broadcast(mask), F.shiftright(place("own"), 6) == F.col("word")).filter(F.col("bits").bitwiseAND(bit("own")) != 0).drop("word", "bits")


def _whole_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, n, grams of the chosen nodes (node, digest and id of one of their rows)."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = [x for x in shingle_sets(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), digest("text").alias("own"), "text")
    rows = _may_be_chosen(rows, chosen)
    found = rows.join(chosen, (rows["own"] == chosen["digest"]) & rows["id"].eqNullSafe(chosen["doc_id"])).select("node", "text")
    return found.mapInArrow(run, "node long, n long, grams binary").groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))


def _entries(rows: DataFrame, blob: str) -> DataFrame:
    """node, n, gram: an entry of the matrix a row, from the shingles in a binary column."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("gram", pa.int64())])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = part.column(2).to_pylist()
                many = [len(x) // 8 for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(k).to_numpy(), many)) for k in (0, 1)] + [pa.array(np.frombuffer(b"".join(own), np.int64))], schema=schema)

    return rows.select("node", "n", blob).mapInArrow(flat, "node long, n long, gram long")


def _columns(sets: DataFrame) -> DataFrame:
    """Of rows that can have a partner: node, n, the columns to multiply (sorted), and the last of them (frequency, shingle)."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.binary()), ("last_n", pa.int64()), ("last", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by node, rarest columns first; a node may go over batches."""
        rest = [np.zeros(0, np.int64)] * 4

        def take(node: np.ndarray, n: np.ndarray, gram: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            m = np.diff(np.append(begin, len(node)))
            many = m - -(-LINK * n[begin] // 100) + 1
            begin, many = begin[many > 0], many[many > 0]
            last = begin + many - 1
            prefix = [np.sort(gram[i : i + k].view(np.uint64)).tobytes() for i, k in zip(begin.tolist(), many.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(node[begin]), pa.array(n[begin]), pa.array(prefix, pa.binary()), pa.array(often[last]), pa.array(gram[last])], schema=schema)

        for batch in batches:
            rest = [np.concatenate([a, c.to_numpy()]) for a, c in zip(rest, batch.columns, strict=True)]
            if len(rest[0]) >= GRAMS:
                other = np.flatnonzero(rest[0] != rest[0][-1])
                whole = int(other[-1]) + 1 if len(other) else 0
                yield take(*(a[:whole] for a in rest))
                rest = [a[whole:] for a in rest]
        yield take(*rest)

    grams = _entries(sets, "grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("often")).filter("often > 1")
    shared = grams.join(often, "gram").select("node", "n", "gram", "often")
    return shared.repartition("node").sortWithinPartitions("node", "often", "gram").mapInArrow(cut, "node long, n long, prefix binary, last_n long, last long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets link."""
    side = lambda c, g: sets.select(F.col("node").alias(c), F.col("grams").alias(g))
    both = pairs.join(side("b", "gb"), "b").join(side("a", "ga"), "a").select("a", "b", "ga", "gb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            kept = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                common = overlap(own, other)
                kept.append(100 * common >= LINK * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def product(rows: list[tuple], gram: int, across: bool) -> Iterator[tuple[int, int]]:
    """Pairs of one cell that may link: rows of the matrix times themselves, or (``across``) two blocks of rows.

    A row is (block, node, component, n, prefix, last), ``last`` ordering the columns. Only pairs of different components,
    fitting sizes and with ``gram`` as their smallest common column are taken, and only if the overlap in the columns
    multiplied, plus the most that may follow, suffices.
    """
    n = np.array([r[3] for r in rows])
    least = -(-LINK * n // 100)
    block, part = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    last = {x: k for k, x in enumerate(sorted({r[5] for r in rows}))}
    last = np.array([last[r[5]] for r in rows])
    column = np.concatenate([r[4] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1], [True]]))
    counts, before = np.zeros((len(rows), len(rows)), np.int32), np.zeros((len(rows), len(rows)), bool)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if j - i > 1:
            at = np.ix_(owner[i:j], owner[i:j])
            counts[at] += 1
            if int(column[i]) < gram:
                before[at] = True
    need = -(-LINK * (n[:, None] + n[None, :]) // (100 + LINK))
    follow = np.where(last[:, None] == last[None, :], np.minimum(least[:, None], least[None, :]), np.where(last[:, None] < last[None, :], least[:, None], least[None, :])) - 1
    good = (counts > 0) & ~before & (counts + follow >= need) & (part[:, None] != part[None, :])
    good &= 100 * np.minimum(n[:, None], n[None, :]) >= LINK * np.maximum(n[:, None], n[None, :])
    good &= (block[:, None] < block[None, :]) if across else np.triu(np.ones(counts.shape, bool), 1)
    for a, b in zip(*np.nonzero(good), strict=True):
        yield tuple(sorted((rows[a][1], rows[b][1])))


def _apart(members: DataFrame, profiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs a, b of different components that may link: cells (column, two blocks of its rows) of the product.

    ``members``: gram, node, component; a task holds the rows of one cell, two blocks at most.
    """
    sizes = members.groupBy("gram", "component").agg(F.count("*").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    own = members.join(sizes.select("gram", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "gram").join(profiles, "node")
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("low"), F.greatest(x, F.col("block")).alias("high")))
    cells = own.select("gram", F.explode(others).alias("cell"), "block", "node", "component", "n", "prefix", "last_n", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                pairs = list(product(rows, int(np.int64(now[0]).view(np.uint64)), now[1] < now[2]))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], schema=schema)

        for batch in batches:
            for gram, low, high, place, node, component, n, prefix, often, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (gram, low, high):
                    yield from done()
                    now, rows = (gram, low, high), []
                rows.append((place, node, component, n, np.frombuffer(prefix, np.uint64), (often, last)))
        yield from done()

    flat = cells.select("gram", "cell.low", "cell.high", "block", "node", "component", "n", "prefix", "last_n", "last")
    return flat.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high").mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, component of nodes with links."""
    sets = written(_whole_sets(docs, chosen), "sets")
    profiles = written(_columns(sets), "profiles")
    grams = _entries(profiles, "prefix")
    often = grams.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1")
    members = written(grams.join(often, "gram"), "members")
    # the row that meets most others is the best centre; two more are drawn by one hash for all columns, so that
    # columns which share rows draw the same ones
    known = members.groupBy("node").agg(F.sum("rows").alias("met"))
    ranked = members.join(known, "node").select("gram", F.struct("met", "node", "n").alias("known"), F.struct(F.xxhash64("node").alias("h"), "node", "n").alias("drawn"))
    centres = ranked.groupBy("gram").agg(F.array_distinct(F.array(*(F.struct(x["node"].alias("centre"), x["n"].alias("size")) for x in (F.max("known"), F.max("drawn"), F.min("drawn"))))).alias("centres"))
    near = members.join(centres, "gram").select("node", "n", F.explode("centres").alias("c")).filter((F.col("node") != F.col("c.centre")) & _sizes_fit(F.col("n"), F.col("c.size")))
    stars = written(near.select(F.least("node", "c.centre").alias("a"), F.greatest("node", "c.centre").alias("b")).distinct(), "stars")
    links = written(_linked(stars, sets), "links")
    parts = components(links)
    rest = members.select("gram", "node").join(parts, "node", "left").select("gram", "node", F.coalesce("component", "node").alias("component"))
    extra = written(_linked(_apart(rest, profiles).join(stars, ["a", "b"], "left_anti"), sets), "links")
    if not extra.isEmpty():
        parts = components(links.union(extra))
    discard(sets, profiles, members, stars, links, extra)
    return parts


def similar_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are parted by the six ASCII white-space signs, A to Z count as small letters. A null text and a text without
    words have an empty set, no links and their own doc_id as component; a text of one to three words is one shingle.
    Rows that share a doc_id are judged each by its own text. Rows with a null doc_id link others and have their
    component's id, which is null where it has no other row. Repeated rows stay repeated. An empty table gives an empty
    one; other columns than doc_id and text are ignored, whatever their names.
    """
    rows = written(_rows(docs), "rows")
    nodes = rows.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sample", ignorenulls=True).alias("sample"), F.min(F.struct("doc_id", "digest")).alias("own"), F.min("doc_id").alias("low"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "n", "sample", "own.doc_id", "own.digest", "low"), "nodes")
    held, rows = rows, written(rows.select("doc_id", "n", "key"), "rows")
    discard(held)
    sampled = nodes.select("node", "n", "doc_id", "digest", (F.octet_length("sample") / 8).alias("sampled"))
    own = F.col("sampled") - F.coalesce("shared", F.lit(0))
    chosen = written(sampled.join(_shared(nodes), "node", "left").filter(own <= F.col("n") - least(F.col("n"))).select("node", "doc_id", "digest"), "chosen")
    held, nodes = nodes, written(nodes.select("node", "key", "low"), "nodes")
    discard(held)
    parts = written(_links(docs, chosen), "parts")
    both = nodes.select("node", "key", "low").join(parts, "node", "left").select("key", "low", F.coalesce("component", "node").alias("component"))
    named = both.join(both.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("key", "component_id")
    found = rows.select("doc_id", "n", "key").join(named, "key", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
