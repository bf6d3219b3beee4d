"""Media columns: interleaved documents of text and media references, payloads kept apart by digest.

``interleave`` parses HTML into ordered items: text, or a media reference with its digest and caption.
``store_media`` writes payloads once for each task as 8-bit mono WAV; ``media_features`` reads them back, one row a
digest; ``resolve`` joins the two, with frequent digests apart; an item keeps its position and caption whatever the join does.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.storage import written

UNIT, RATE = 64, 8000
ITEM = "position int, kind string, text string, digest string, caption string, source_bytes long"


def wav(payload: bytes) -> bytes:
    """``payload`` as the samples of an 8-bit mono WAV file."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, its chunks read one after another."""
    at = 12
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: Column) -> Column:
    """UTF-8 bytes and zero bytes up to a positive multiple of UNIT."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / UNIT)) * UNIT
    return F.rpad(raw, size.cast("int"), F.lit(b"\x00"))


def as_page(text: Column, digest: Column, caption: Column) -> Column:
    """An HTML page: the text, then a figure that refers to its payload."""
    raw = F.coalesce(text, F.lit(""))
    safe = F.replace(F.replace(F.replace(raw, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<article><p>"), safe, F.lit('</p><figure><audio src="sha256:'), digest, F.lit('" data-bytes="'), F.octet_length(raw).cast("string"), F.lit('"></audio><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


class _Items(HTMLParser):
    SKIP = {"script", "style", "template"}
    MEDIA = {"img", "audio", "video", "source"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.parts: list[str] = []
        self.hidden, self.caption, self.figure = 0, None, None

    def flush(self) -> None:
        text = "".join(self.parts).strip()
        self.parts.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.hidden += 1
        elif tag in self.MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                size = a.get("data-bytes") or ""
                item = {"kind": "media", "digest": a["src"].removeprefix("sha256:"), "caption": a.get("alt"), "source_bytes": int(size) if size.isdigit() and len(size) < 19 else None}
                self.items.append(item)
                if self.figure is not None:
                    self.figure.append(item)
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = "".join(self.caption).strip()
            for item in self.figure or ():
                item["caption"] = text
            if text and not self.figure:
                self.items.append({"kind": "text", "text": text})
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in {"p", "div", "li", "h1", "h2", "h3", "article", "section", "td"}:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.parts if self.caption is None else self.caption).append(data)


def items(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def interleave(pages: DataFrame, key: str, html: str, kinds: tuple[str, ...] = ("text", "media")) -> DataFrame:
    """``key`` (a long) and one row an item, positions from 0 over all kinds. Null or empty HTML has no items."""
    names = ("position", "kind", "text", "digest", "caption", "source_bytes")
    schema = pa.schema([(key, pa.int64()), ("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("source_bytes", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, (key, html)):
            yield record(schema, [(i, *(x.get(n) for n in names)) for i, t in zip(ids, texts, strict=True) for x in ({"position": at} | item for at, item in enumerate(items(t))) if x["kind"] in kinds])

    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(parse, f"{key} long, {ITEM}")


def store_media(payloads: DataFrame, column: str) -> DataFrame:
    """Write binary ``column`` as WAV files in a table: digest, media, copies. A payload may stand in it more than once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.string()), ("media", pa.binary()), ("copies", pa.int64())])
        for (raw,) in slices(batches, (column,)):
            copies = Counter(p for p in raw if p is not None)
            yield record(schema, [(hashlib.sha256(p).hexdigest(), wav(p), n) for p, n in copies.items()])

    return written(payloads.select(column).mapInArrow(encode, "digest string, media binary, copies long"), "media")


FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_features(store: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes, and its copies. The digest of the samples is that of the bytes read back."""
    schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("copies", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, stored, copies in slices(batches, ("digest", "media", "copies")):
            rows = []
            for digest, media, n in zip(digests, stored, copies, strict=True):
                p = samples(media)
                v = np.frombuffer(p, np.uint8).astype(np.int32) - 128
                feature = f"sum={int(v.sum())};energy={int((v.astype(np.int64) ** 2).sum())};peak={int(np.abs(v).max(initial=0))};crossings={int((np.diff(np.signbit(v)) != 0).sum())}"
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, n))
            yield record(schema, rows)

    found = store.mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, copies long")
    # equal payloads have equal rows; as one value they are grouped by hash, not by sorting
    return written(found.groupBy("digest").agg(*(F.max(c).alias(c) for c in FEATURES), F.sum("copies").alias("copies")), "features")


def resolve(sequence: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Every item with what its digest leads to; unknown digests and text items have nulls there.

    ``features`` is a written table with the copies of each digest. Digests of more than a quarter of a partition's
    share of all copies, fewer than four times the partitions, are looked up in a broadcast table; the others are joined.
    """
    spark = sequence.sparkSession
    share = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = features.agg(F.sum("copies")).first()[0] or 0
    frequent = features.filter(F.col("copies") > max(1, total // share)).select(F.col("digest").alias("__digest"), F.struct(*FEATURES).alias("__hot"))
    own = sequence.join(F.broadcast(frequent), F.col("digest") == F.col("__digest"), "left")
    # items that are resolved, and those without a digest, go their own way through the join
    own = own.withColumn("__key", F.when(F.col("__hot").isNotNull() | F.col("digest").isNull(), F.concat(F.lit("-"), F.xxhash64(key, "position").cast("string"))).otherwise(F.col("digest")))
    rest = features.select(F.col("digest").alias("__key"), F.struct(*FEATURES).alias("__own"))
    found = own.join(rest, "__key", "left").withColumn("__found", F.coalesce("__hot", "__own"))
    return found.select(*sequence.columns, *(F.col(f"__found.{c}").alias(c) for c in FEATURES))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id and text -> one row a document with the features of its payload. Null texts are empty, copies equal.

    Rows that share a doc_id, or have none, have a row each. Other columns are ignored; an empty table gives none.
    """
    payload = docs.select("doc_id", "text").withColumn("payload", padded(F.col("text")))
    features = media_features(store_media(payload, "payload"))
    pages = payload.select("doc_id", as_page(F.col("text"), F.sha2("payload", 256), F.lit("the text as samples")).alias("html"))
    sequence = interleave(pages, "doc_id", "html", kinds=("media",))
    return resolve(sequence, features, "doc_id").select("doc_id", F.col("source_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
