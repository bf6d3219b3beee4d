"""Hot values, odd keys and very long texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from termloom.llm import chat, licenses, media, minhash, packing, queries, repeats, token_file, warc

rng = np.random.default_rng(41)
VOCABULARY = ["".join(rng.choice(list("abcdeéilnoprstu"), rng.integers(3, 9))) for _ in range(900)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def test_urls_that_would_break_a_header(spark):
    rows = [(1, "http://a/\r\n\r\nb", "x"), (1, "http://a/  é", "y"), (1, None, "z"), (None, "u\x00", "n"), (None, "u", "m")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["payload_digest"]) for r in got) == Counter((i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows)
    assert {r["url"] for r in got} == {"http://a/%0D%0A%0D%0Ab", "http://a/%E2%80%A8%20é", "", "u%00", "u"}


def test_record_ids_differ(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(7, f"u{i}", f"text {i}") for i in range(5)], "page_id long, url string, html string").repartition(3)
    m = warc.write_warc(df, f"file://{tmp_path}/w")
    ids = [h["WARC-Record-ID"] for r in m.collect() for h, _ in warc.records(gzip.open(f"{tmp_path}/w/{r['file']}"))]
    assert len(set(ids)) == 5 and "<urn:page:7>" in ids


def test_one_text_in_half_of_the_rows(spark):
    rows = [(i, "same" if i % 2 else f"text {i}") for i in range(4000)] + [(None, None), (5, "same")]
    got = media.document_media(spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, digest string, payload long")).collect()
    assert len(got) == len(rows) and len({r["feature"] for r in got if r["n_bytes"] == 4 and r["payload_bytes"] == 64 and r["position"] == 1}) == 1
    for r in got:
        assert r["payload_sha256"] and r["media_sha256"] and r["caption"] == "the text as samples"
        assert r["position"] == (1 if r["n_bytes"] else 0)


def test_rows_without_ids_are_documents_of_their_own(spark):
    shared = "".join(rng.choice(list("abcdefgh"), 230))
    texts = [f"{i} " + ("x" * (i % 50)) + (shared if i % 10 == 0 else prose(40)) for i in range(3000)] + [shared, shared]
    df = spark.createDataFrame([(None if i % 2 else -(2**63), t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    windows = Counter(t.encode()[k : k + 200] for t in texts for k in range(len(t.encode()) - 199))
    want = Counter()
    for i, t in enumerate(texts):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 199):
            if windows[raw[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want[(None if i % 2 else -(2**63), len(raw), sum(gone))] += 1
    assert got == want


def test_a_conversation_of_the_trap_s_id_stays(spark, tmp_path):
    spark.createDataFrame([(-1, 0, "user", "mine"), (4, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r["conv_id"], r["n_turns"]) for r in queries.op9_chat_format(spark, str(tmp_path)).collect()) == [(-1, 1), (-1, 2), (4, 1)]


@pytest.fixture(scope="module")
def long_rows(spark):
    """A text of a megabyte of words, one of a megabyte without a blank, and a short one; columns with inner names."""
    rows = [(1, prose(150_000)), (2, "ab" * 500_000), (3, "short"), (3, "short")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, b"") for i, t in rows], "doc_id long, text string, lang string, node string, bucket long, key long, ids binary")


def test_very_long_texts(long_rows):
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(long_rows).collect()} == {1: 150_000, 2: 1, 3: 1}
    assert len(media.document_media(long_rows).collect()) == 4
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(long_rows).collect()} == {1: 1, 2: 2, 3: 3}
    sizes = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(long_rows).collect()}
    assert sizes[2] == (1_000_000, 1_000_000) and sizes[1][1] == 0 and sizes[3] == (5, 0)
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_file.token_ids(long_rows).collect()}
    pieces = packing.pack(long_rows).collect()
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == n for i, n in tokens.items() if i < 3)


def test_a_long_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|^" * 200_000), (1, 1, "assistant", "y" * 300_000)], "conv_id long, turn long, role string, text string")
    r = chat.chat_digests(df).first()
    assert (r["n_turns"], r["loss_chars"]) == (2, 300_000)
