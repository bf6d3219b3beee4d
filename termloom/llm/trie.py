"""Prefix trie of conversations, built level by level and rolled up level by level.

Conversations are rebuilt first: some take their first turns from another one. At each depth the live conversations are
grouped by their node and next turn; a node is named by its depth and its smallest conversation. A conversation that is alone
in its node goes no further, as the rest of it is a chain without branches that one join writes down; so there are as many
levels as the longest prefix that two conversations share. Then levels are joined from the deepest to the root, each adding up
leaves and savings of the one below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.running import running_total
from termloom.llm.storage import discard, written

#: Conversations with this remainder lend their first turns to those of their hundred; at most HEADS - 1 of them.
LENDER, HEADS = 100, 6
#: Decimal ids that are joined to one text at a time.
PIECE = 50_000


def _mark(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), mark, chars of every turn, in order of turn (null first), then of mark.

    Texts stay where they are read; only their digests are sorted. Rows are numbered by running totals, so a conversation
    of very many turns needs no task of its own.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    own = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _mark(role, text).alias("mark"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    placed = running_total(own, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("mark").asc()], "one", "place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first")).alias("at"), "mark", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, size of every conversation as it is rebuilt, and conv_id, depth (from 1), mark, chars of its turns."""
    own = written(numbered(turns), "numbered")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    lent = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % LENDER
    lenders = convs.filter(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    # a conversation that is its own lender keeps its turns: it lends itself as many as it gives up
    known = convs.select("conv_id", "n", base.alias("base"), lent.alias("lent")).join(lenders, "base", "left")
    known = written(known.select("conv_id", "n", "base", "lent", F.least("lent", F.coalesce("there", F.lit(0))).alias("head")), "lending")
    heads = own.filter((F.col("at") < HEADS - 1) & (F.col("conv_id") == base)).select(F.col("conv_id").alias("base"), "at", "mark", "chars")
    borrowed = known.select("conv_id", "base", "head").join(heads, "base").filter("at < head").select("conv_id", (F.col("at") + 1).alias("depth"), "mark", "chars")
    kept = own.join(known.select("conv_id", "lent", "head"), "conv_id").filter("at >= lent").select("conv_id", (F.col("at") - F.col("lent") + F.col("head") + 1).alias("depth"), "mark", "chars")
    sizes = written(known.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))).alias("size")), "convs")
    # by depth, so that a level reads only its own files
    steps = written(borrowed.union(kept).repartitionByRange("depth", F.xxhash64("conv_id")).sortWithinPartitions("depth"), "steps")
    discard(own, known)
    return sizes, steps


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, node, conv_id -> depth, node, ends_sha256: the ids of a node in order, comma-joined, digested.

    A range sort puts ids in order, tasks join them to pieces of text, and a node's pieces stream through its digest, so
    however many conversations end in one node, a task holds one piece.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces_schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("piece", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, now, held = TaskContext.get().partitionId(), 0, None, []

        def piece() -> pa.RecordBatch:
            nonlocal k, held
            k += 1
            row = (*now, part, k, ",".join(map(str, held)))
            held = []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, pieces_schema, strict=True)], schema=pieces_schema)

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (now != (depth, node) or len(held) >= PIECE):
                    yield piece()
                now = (depth, node)
                held.append(conv)
        if held:
            yield piece()

    schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for depth, node, _, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (depth, node):
                    sha.update(b"," + piece.encode())
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, node), hashlib.sha256(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, sha.hexdigest()), schema, strict=True)], schema=schema)

    order = ["depth", "node", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, "depth long, node long, part int, k long, piece string")
    return pieces.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "part", "k").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie over the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (of the subtree), ends_sha256 (of the ids of conversations that end in the node). Turns stand in order of turn, null
    first; turns of equal number in order of the SHA-256 of role and text; repeated rows are turns of their own. Null roles and
    texts are empty. Rows with a null conv_id are no conversation and are left out. No conversations, no rows, not even
    the root. Other columns are ignored, whatever their names.
    """
    convs, steps = rebuilt(turns)
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).first()
    if not root["n_convs"]:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    levels = [turns.sparkSession.createDataFrame([(None, root["node"], root["n_convs"], 0)], "parent long, node long, n_convs long, chars long")]
    live = [convs.withColumn("node", F.lit(root["node"]))]  # all stand at the root
    alone = [levels[0].filter("n_convs = 1").select("node", F.lit(0).cast("long").alias("depth"))]
    more = root["n_convs"] > 1
    while more:
        depth = len(levels)
        turn = steps.filter(F.col("depth") == depth).select("conv_id", "mark", "chars")
        next_turn = written(live[-1].withColumnRenamed("node", "parent").join(turn, "conv_id"), "next")
        groups = written(next_turn.groupBy("parent", "mark").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("chars").alias("chars")), "level")
        shared = groups.filter("n_convs > 1")
        more = not shared.isEmpty()
        if more:
            live.append(written(next_turn.join(shared.select("parent", "mark", "node"), ["parent", "mark"]).select("conv_id", "size", "node"), "live"))
        levels.append(groups)
        alone.append(groups.filter("n_convs = 1").select("node", F.lit(depth).cast("long").alias("depth")))
        discard(next_turn)
    rolled, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        own = levels[depth].select(F.lit(depth).cast("long").alias("depth"), "parent", "node", "n_convs", "chars")
        if below is None:
            kids = own.select(F.col("node").alias("up"), *(F.lit(None).cast("long").alias(c) for c in ("n_children", "leaves", "saved"))).limit(0)
        else:
            kids = below.groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        joined = own.join(kids, own["node"] == kids["up"], "left")
        saved = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))
        below = written(joined.select("depth", F.col("node").alias("conv_id"), F.col("parent"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens")), "rolled")
        rolled.append(below)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    branching = union(rolled)
    chains = union(alone).withColumnRenamed("node", "conv_id").join(convs, "conv_id")
    # a chain's nodes have one member; the first of them is in its level already
    first = chains.select("conv_id", "depth", (F.col("size") > F.col("depth")).cast("long").alias("kids"))
    later = chains.select("conv_id", "size", F.explode(F.when(F.col("size") > F.col("depth"), F.sequence(F.col("depth") + 1, F.col("size")))).alias("depth"))
    later = later.select("depth", "conv_id", F.col("conv_id").alias("parent"), F.lit(1).cast("long").alias("n_convs"), (F.col("size") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    nodes = branching.join(first, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("kids", "n_children")).drop("kids").unionByName(later)
    none = hashlib.sha256(b"").hexdigest()
    ends = id_digests(union([d.filter(F.col("size") == k).select(F.lit(k).cast("long").alias("depth"), "node", "conv_id") for k, d in enumerate(live)]).join(chains.select("conv_id"), "conv_id", "left_anti"))
    ends = ends.unionByName(chains.select(F.col("size").alias("depth"), F.col("conv_id").alias("node"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256")))
    found = nodes.join(ends.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    return found.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
