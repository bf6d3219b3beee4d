"""Operators on small fixtures: brute force, round trips and edge cases."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm import bpe, chat, langid, leaks, licenses, media, minhash, packing, repeats, token_file, warc
from termloom.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, start long"
rng = np.random.default_rng(3)
VOCABULARY = ["".join(rng.choice(list("abcdeéilnoprstu"), rng.integers(2, 9))) for _ in range(600)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


A, B, C = prose(120), prose(90), prose(300)
#: Nulls, empty and repeated texts, no letters, odd white space, repeated rows, clashing columns.
TEXTS = [(1, A), (2, None), (3, ""), (4, A), (5, B + " " + A), (6, "!!! ???"), (7, "  a\n\n  b\t"), (8, C), (8, C), (9, C.replace(" ", "  ", 3) + " x"), (10, A + " end"), (11, "ab" * 300), (None, B)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", 0, 1.5, 7) for i, t in TEXTS], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["mit"]
    df = spark.createDataFrame([(1, "x Under THE mit license, cc by nc"), (2, "Copyright me. " + mit), (3, None), (4, "under the the mit license")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in licenses.scan_licenses(df).collect()}
    assert (r[1]["n_words"], r[1]["n_base"], r[1]["first_word"], r[1]["last_word"], r[1]["base_labels"]) == (8, 2, 1, 5, "cc-by-nc,mit")
    assert r[2]["labels"] == "mit" and r[2]["base_labels"] == "" and r[2]["score"] > 0.9
    assert (r[3]["n_words"], r[3]["n_base"], r[3]["score"]) == (0, 0, 0.0)
    assert r[4]["n_base"] == 0
    assert licenses.scan_licenses(docs).count() == len(TEXTS) and licenses.scan_licenses(empty).count() == 0


def test_a_template_that_repeats_a_phrase():
    """The second match of a repeated phrase goes on where the chain stands, so all of the template is covered."""
    template = "one two three four five six one two three four five seven eight nine ten eleven"
    automaton = licenses.SuffixAutomaton({}, {"x": template})
    text = template.replace("six", "six zzz").split()
    assert automaton.spans(automaton.scan(text)[1]) == [("x", 1.0, 0, len(text))]
    assert automaton.spans(automaton.scan(template.split())[1]) == [("x", 1.0, 0, 16)]


def test_phrases_against_brute_force():
    automaton = licenses.SuffixAutomaton(licenses.PHRASES, licenses.TEMPLATES)
    pool = sorted({w for p in licenses.PHRASES for w in p.split()} | {"of"})
    for _ in range(300):
        text = list(rng.choice(pool, 60))
        text[10:14], text[30:33] = "apache license version 2".split(), "cc by nc".split()
        want = sorted((i, len(p.split()), label) for p, label in licenses.PHRASES.items() for i in range(len(text)) if text[i : i + len(p.split())] == p.split())
        assert sorted(automaton.scan(text)[0]) == want


def test_media(docs, empty):
    rows = media.document_media(docs).collect()
    assert len(rows) == len(TEXTS) and media.document_media(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    for i, t in TEXTS:
        raw = (t or "").encode()
        p = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (by[i]["n_bytes"], by[i]["payload_bytes"], by[i]["payload_sha256"], by[i]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[1]["feature"] == by[4]["feature"] and by[2]["feature"] == by[3]["feature"]


def test_interleaving():
    html = '<p>one</p><img src="sha256:aa" alt="x"><figure><img src="sha256:bb"><figcaption>cap</figcaption></figure><script>no</script><p>two &amp; three'
    assert [(i["kind"], i.get("text") or i["digest"], i.get("caption")) for i in media.items(html)] == [("text", "one", None), ("media", "aa", "x"), ("media", "bb", "cap"), ("text", "two & three", None)]


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (2, "u2", "small"), (3, "u3", big), (4, "u4", None), (5, "u5", "small"), (None, "u6", big), (3, "u3", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter([(1, 1200, sha(big), "revisit", 3), (2, 5, sha("small"), "response", None), (3, 1200, sha(big), "response", None), (3, 1200, sha(big), "response", None), (4, 0, sha(""), "response", None), (5, 5, sha("small"), "response", None), (None, 1200, sha(big), "revisit", 3)])
    assert got == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_files_are_the_same_again(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", prose(200)) for i in range(60)], "page_id long, url string, html string")
    files = []
    for n, parts in ((1, 1), (2, 7)):
        m = warc.write_warc(df.repartition(parts), f"file://{tmp_path}/w{n}", shard_bytes=20_000, roll_bytes=6_000)
        files.append(sorted((r["file"], r["records"], r["sha1"]) for r in m.collect()))
    assert files[0] == files[1] and len(files[0]) > 4


def test_tokens_are_the_library_s():
    t, enc = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    texts = [t or "" for _, t in TEXTS] + ["a   b  c", "x\n \ny", " \t lead", "trail  ", "it's 12,5!! <|endoftext|> z<|endoftext|>", "a  b \x1c c", "z" * 500, "\n", "a|b\x85c"]
    texts += ["it's We'LL don't, é's x'd", "word—next a,b;c ǅabc ʰabc aʰ, ßx² 12abc abc12 _a_ a_b", "İstanbul’s ͅa á, b", "a\x1cb |x| <|endoftext|>,a", "ªº µm Ⅷa aⅧ, 中文,字 a中"]
    texts += ["\n\n<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|> \t", "x <|endoftext|", "\n <|endoftext|>\n <|endoftext|>é"]
    signs = ["<|endoftext|>", " ", "\n", "\t", "a", "it's", "é", "1", "|", "<", "\u3000", "\x1c", ",", "Word"]
    texts += ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 12))) for _ in range(3000)]
    for text, raw in zip(texts, enc.ids(texts), strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(docs, empty):
    t = Tokenizer.from_file(PATH)
    rows = sorted(token_file.token_ids(docs).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, text) in zip(rows, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.token_ids(empty).count() == 0


def test_one_doc_id_in_many_files(spark):
    """Rows that share a doc_id may fall into several files; their order and places hold."""
    rows = [(None if i % 3 == 0 else 5, f"text {i} " * (i % 7)) for i in range(200)] + [(6, "last")]
    got = sorted(token_file.token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["start"])
    t, at = Tokenizer.from_file(PATH), 0
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda text: zlib.crc32(np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert Counter(r["ids_crc32"] for r in got) == Counter(crc(x) for _, x in rows)


def test_elias_fano():
    for values in ([0], [5, 5, 5], [0, 1, 2**40], np.sort(rng.integers(0, 10**7, 3000)).tolist(), list(range(1000))):
        head, raw = token_file.EliasFano.encode(np.array(values))
        back = token_file.EliasFano.decode(json.loads(json.dumps(head)), raw)
        assert back.select(0, len(values)).tolist() == values
        assert [int(back.select(k)[0]) for k in range(0, len(values), 37)] == values[::37]


def test_packing(docs, empty):
    t = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, length=64).collect()
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or s == max(r["sequence_id"] for r in rows)
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids) * sum(x[0] == i for x in TEXTS)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    assert packing.pack(empty).count() == 0


def test_hilbert_neighbours():
    at = {packing.hilbert([x, y, z], 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(511))


@pytest.mark.parametrize("small", [2000, 1])
def test_repeats(docs, empty, small, monkeypatch):
    monkeypatch.setattr(repeats, "SMALL", small)
    windows = Counter((t or "").encode()[i : i + 200] for _, t in TEXTS for i in range(len((t or "").encode()) - 199))
    got = Counter((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - 199):
            if windows[raw[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        runs = sum(covered[k] and not (k and covered[k - 1]) for k in range(len(raw)))
        want[(i, sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(raw, covered, strict=True) if not c)).hexdigest())] += 1
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0
    assert repeats.without_repeats(docs).columns == docs.columns


def test_near_duplicates(docs, empty, spark):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 1, 11: 11}
    assert minhash.near_duplicates(empty).count() == 0
    base = prose(200).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # copies that are near the original, not near each other
        own = list(base)
        for k in rng.choice(200, 3, replace=False):
            own[k] = f"w{i}x{k}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, prose(200)) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0 if i < 100 else i) for i, _ in rows)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (61, 60)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 61: 50}


def test_leaks(spark, docs, empty):
    items = [(1, " ".join(prose(40).split()[:40]) + ". " + prose(6)), (2, prose(30)), (3, None), (4, "")]
    own = [(i, prose(200)) for i in range(60)]
    own[7] = (7, prose(90) + " " + items[0][1].upper() + " " + prose(70))
    own[9] = (9, items[1][1].replace(" ", ", ", 5))
    df = spark.createDataFrame(own + [(100, None), (101, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.benchmark_leaks(df, benchmark).collect()) == [(7, 1), (9, 2)]
    assert leaks.benchmark_leaks(empty, benchmark).count() == 0
    assert leaks.benchmark_leaks(docs, benchmark.limit(0)).count() == 0


def test_language(spark, docs, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.document_languages(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)
    r = {x["doc_id"]: x for x in langid.document_languages(docs).collect()}
    assert r[2]["lang_pred"] == r[3]["lang_pred"] == r[6]["lang_pred"] == "und" and r[1]["lang_pred"] == "en"
    assert langid.document_languages(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a^0<|x|>"), (1, 1, "user", "</s><+>"), (1, 2, "assistant", None), (1, 3, "assistant", "^1^"), (2, None, None, "x"), (None, 0, "a|b>", "y"), (1, 3, "assistant", "^1^")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert back == {1: [("user", "a^0<|x|>"), ("user", "</s><+>"), ("assistant", ""), ("assistant", "^1^"), ("assistant", "^1^")], 2: [("", "x")], None: [("a|b>", "y")]}
    assert chat.chat_digests(df.limit(0)).count() == 0
