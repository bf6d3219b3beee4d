"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id and cut into shards of about ``shard_bytes`` of payload at exact running
totals, so the same pages give the same files on any cluster. A shard rolls to a new file by compressed size.
Headers and digests are made anew from the payload. Files are written under temporary names, renamed, and named
in a manifest that is written last; the reader opens only what the manifest names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.running import running_total
from termloom.llm.storage import filesystem, new_dir, publish, shuffles_dropped, written

REVISIT_FROM, ROLL_BYTES, DATE = 1000, 256 << 20, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signs that would break a header line; they are percent-encoded in urls.
UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")
MANIFEST = "file string, shard long, records long, bytes long, sha1 string"


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, place: int = 0) -> bytes:
    """``place`` is 0 for the first record of a page_id; it tells the record ids of further ones apart."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}{f':{place}' if place else ''}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {UNSAFE.sub(lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without a time stamp
    return z.compress(raw) + z.flush()


def _order(page_id: Column) -> Column:
    """Null page ids come first."""
    return F.coalesce(page_id, F.lit(-(2**63)))


def write_warc(pages: DataFrame, path: str, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write page_id, url, html (null: empty) as gzipped WARC and return the manifest.

    Of pages with equal payloads of REVISIT_FROM bytes or more, that with the largest page_id (rows that share it
    too) is a response, the others are revisits of it. Rows with a null page_id count as the smallest.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    facts = written(own.select(_order(F.col("page_id")).alias("at"), "url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest")), "warc-facts")
    winners = facts.filter(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.max("at").alias("winner"))
    revisits = facts.filter(F.col("size") >= REVISIT_FROM).join(winners, "digest").filter("at < winner").select("at", "digest", "winner").distinct()
    # one row a page id, so that rows which share it fall into one shard
    sizes = facts.groupBy("at").agg(F.sum("size").alias("size"))
    if shard_bytes is None:
        total = facts.agg(F.sum("size")).first()[0] or 0
        shard_bytes = max(4 << 20, min(1 << 30, total // 1024))
    starts = running_total(sizes, [F.col("at")], "size", "before").withColumn("shard", F.floor(F.col("before") / shard_bytes))
    # a number for each shard, as a range sort has for each partition
    firsts = np.array([r["at"] for r in starts.groupBy("shard").agg(F.min("at").alias("at")).orderBy("at").collect()], np.int64)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("at")).to_numpy(zero_copy_only=False)
            yield batch.append_column("shard", pa.array(np.searchsorted(firsts, at, "right") - 1, pa.int64()))

    rows = own.select(_order(F.col("page_id")).alias("at"), F.lit(1).alias("kind"), "page_id", "url", "payload", F.lit(None).cast("long").alias("winner"))
    marks = revisits.select("at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit("").alias("url"), F.lit(b"").alias("payload"), "digest", "winner")
    fields = "at long, kind int, page_id long, url string, payload binary, digest string, winner long, shard long"
    sharded = rows.withColumn("digest", F.sha1("payload")).select(marks.columns).unionByName(marks).mapInArrow(tag, fields)
    sorted_rows = sharded.repartition(max(n, len(firsts)), "shard").sortWithinPartitions("shard", "at", "digest", "kind", "url", "page_id")
    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        shard = out = None
        roll = records = size = 0
        digest, mark, last, place = hashlib.sha1(), (None, None, None), None, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"pages-{shard:08d}-{roll:04d}.warc.gz"
            publish(store, temporary, f"{root}/{name}")
            return record(schema, [(name, shard, records, size, digest.hexdigest())])

        for found in slices(batches, ("at", "kind", "page_id", "url", "payload", "digest", "winner", "shard"), 64):
            for at, kind, page_id, url, payload, sha1, winner, own_shard in zip(*found, strict=True):
                if kind == 0:
                    mark = (at, sha1, winner)
                    continue
                if out is not None and (own_shard != shard or size >= roll_bytes):
                    yield close()
                    roll = roll + 1 if own_shard == shard else 0
                    out = None
                if out is None:
                    shard, records, size, digest = own_shard, 0, 0, hashlib.sha1()
                    temporary = f"{root}/_temporary/{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary, compression=None)
                place, last = place + 1 if at == last else 0, at
                raw = _record(page_id, url, payload, mark[2] if mark[:2] == (at, sha1) else None, place)
                out.write(raw)
                digest.update(raw)
                records, size = records + 1, size + len(raw)
        if out is not None:
            yield close()

    with shuffles_dropped(spark):
        sorted_rows.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    buffer = bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            got = stream.read(max(1 << 20, n - len(buffer)))
            if not got:
                return False
            buffer.extend(got)
        return True

    def take(n: int) -> bytes:
        if not fill(n):
            raise EOFError("the archive ends inside a record")
        out = bytes(buffer[:n])
        del buffer[:n]
        return out

    while True:
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(buffer)
            if not fill(searched + 1):
                if buffer.strip():
                    raise EOFError("the archive ends inside a record")
                return
        lines = take(end + 4).decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        block = take(int(headers["Content-Length"]))
        take(4)
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the files that the manifest names; a response's digest is made from its payload again."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())])

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0]
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        for (names,) in slices(batches, ("file",)):
            for name in names:
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression="gzip") as stream:
                    for headers, block in records(stream):
                        http, payload = block.split(b"\r\n\r\n", 1)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(next(h for h in http.split(b"\r\n") if h.startswith(b"Content-Length: "))[16:])
                        if kind == "response":
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: a payload differs from its digest")
                            length = len(payload)
                        rows.append((number(headers["WARC-Record-ID"]), length, digest, kind, number(headers.get("WARC-Refers-To")), headers["WARC-Target-URI"], name))
                        if len(rows) == 1000:
                            yield record(schema, rows)
                            rows = []
                yield record(schema, rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(n, "file").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to WARC files in the shared folder and read every record back."""
    path = new_dir(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
