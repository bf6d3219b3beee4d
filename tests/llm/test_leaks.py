"""The latent search against the checks on every window of every document."""

import numpy as np

from termloom.llm import leaks

rng = np.random.default_rng(31)


def brute(docs, items):
    """Pairs that pass the checks in some window, each window tried; an item of which a document has too few words can't."""
    found, known = set(), {k: leaks.described(k, t) for k, t in items if t}
    for d, text in docs:
        words = leaks.hashed(text).tolist()
        seen = set(words)
        for k, item in known.items():
            if sum(m.bit_count() for w, m in item["masks"].items() if w in seen) < leaks.WITH_ANSWER * item["n"]:
                continue
            width = leaks.SCALES[item["scale"]]
            for at in range(max(1, -(-len(words) // leaks.BLOCK) - width + 1)):
                share, answer = leaks.checked(words[at * leaks.BLOCK : (at + width) * leaks.BLOCK], item)
                if share >= leaks.ALONE or share >= leaks.WITH_ANSWER and answer >= leaks.ANSWER:
                    found.add((d, k))
                    break
    return found


def paraphrase(text, others):
    """Every sixth or so word of an item replaced, words put in between, the last sentence kept."""
    *body, last = [s for s in text.split(".") if s.strip()]
    words = " ".join(body).split()
    for i in rng.choice(len(words), len(words) // 6, replace=False):
        words[i] = str(rng.choice(others))
    for _ in range(len(words) // 8):
        words.insert(int(rng.integers(0, len(words))), str(rng.choice(others)))
    return " ".join([*words, last])


def test_recall_against_all_windows(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    others = " ".join(t for _, t in docs[:50] if t).split()
    for n in range(200):
        k, text = items[n % len(items)]
        around = (" ".join(rng.choice(others, int(rng.integers(5, 120)))) for _ in range(2))
        docs.append((10**6 + n, f" {paraphrase(text, others)} ".join(around)))
    want = brute(docs, items)
    found = leaks.benchmark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    planted = {(d, k) for d, k in want if d >= 10**6}
    assert len(planted) > 150 and got <= want
    assert len(got & want) >= 0.97 * len(want) and len(got & planted) >= 0.97 * len(planted)


def test_few_windows_are_candidates(spark):
    """The cosine by itself leaves under one window in a hundred for each item."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    table = leaks.word_table(df)
    idf = leaks.inverse_frequencies(table)
    space = leaks.latent_space(table, idf)
    items = [w for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if len(w := leaks.hashed(r["text"]))]
    z = leaks.unit(leaks.vectors(np.concatenate(items), np.cumsum([0, *(len(w) for w in items[:-1])]), space, idf))
    docs = [w for r in df.limit(400).collect() if len(w := leaks.hashed(r["text"]))]
    n = sum(max(1, -(-len(w) // leaks.BLOCK) - leaks.SCALES[1] + 1) for w in docs) * len(items)
    assert sum(1 for _ in leaks.found_in(docs, space, idf, {1: (z, np.arange(len(items)))})) < 0.01 * n


def test_long_texts_and_odd_ids(spark, monkeypatch):
    """Parts of a long text overlap; null and repeated ids, equal items, empty texts and clashing columns."""
    monkeypatch.setattr(leaks, "PART", 20 * leaks.BLOCK)
    words = ["".join(rng.choice(list("abcdeilnoprstu"), rng.integers(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = prose(40)
    rows = [(i, prose(150)) for i in range(30)]
    rows += [(100 + i, f"{prose(200 + 7 * i)} {item} {prose(300)}") for i in range(12)]
    rows += [(None, f"{prose(50)} {item}"), (None, prose(80)), (7, item), (7, item), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, doc long, words string")
    items = spark.createDataFrame([(1, item), (2, item), (1, item), (3, None), (4, "?!")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in leaks.benchmark_leaks(docs, items).collect()), key=repr)
    assert got == sorted([(d, k) for d in (None, 7, *range(100, 112)) for k in (1, 2)], key=repr)
