"""The pipeline's stages on repeated rows, shared and null ids, against brute force."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import minhash

rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("abcdeéilnoprstu"), rng.integers(3, 9))) for _ in range(900)]
ITEM = " ".join(rng.choice(VOCABULARY, 40))


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


def near(text, n):
    words = text.split()
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"x{k}"
    return " ".join(words)


T = [prose(120) for _ in range(12)]
SPAN = prose(60)
ROWS = [
    (1, T[0]), (1, T[0]), (1, T[0]),  # a row that stands three times
    (2, T[1]), (None, T[1]),  # a copy with a null id
    (None, T[2]), (None, T[2]), (None, T[3]), (None, near(T[3], 2)),  # copies that all have null ids
    (3, T[4]), (3, T[5]), (3, near(T[5], 2)),  # an id of several texts, two of them near copies
    (4, T[6]), (5, near(T[6], 3)), (6, T[6].upper()),
    (7, T[7] + " " + SPAN), (8, T[8] + " " + SPAN),  # a span that repeats across documents
    (None, T[9] + " " + ITEM), (9, T[10] + " " + ITEM), (9, T[11]),
]
ROWS += [(100 + i, prose(200)) for i in range(60)]  # the leak stage's latent space needs a corpus


def brute():
    sets = [minhash.shingles(t) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= minhash.SIMILAR:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (i, t) in sorted(zip(group, ROWS, strict=True), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        least.setdefault(g, []).append((i, t))
    kept = [[r for r in rows if r[0] == rows[0][0]] for rows in least.values()]  # any of the rows of the least id
    return [[(i, t) for i, t in rows if ITEM not in t] for rows in kept if not all(ITEM in t for _, t in rows)]


def without_repeats(texts):
    windows = {}
    for t in texts:
        for k in range(len(t) - 199):
            windows[t[k : k + 200]] = windows.get(t[k : k + 200], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if windows[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def test_one_row_of_each_group_goes_on(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in ROWS], "doc_id long, text string, lang string, n_chars long").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.written(stages["near_duplicates"](spark, docs, str(tmp_path)), "one")
    found = [(r["doc_id"], r["text"]) for r in one.collect()]
    leaked = [r for r in found if ITEM in r[1]]
    want = brute()
    assert len(found) - len(leaked) == len(want) and all(sum(r in rows for r in found) == 1 for rows in want)
    assert sorted(i or 0 for i, _ in leaked) == [0, 9]
    left = corpus_pipeline.written(stages["repeated_spans"](spark, one, str(tmp_path)), "left")
    texts = without_repeats([t.encode() for _, t in found])
    assert sorted(r["text"] for r in left.collect()) == sorted(t for t in texts if t.strip())
    # the item itself repeats across rows, so leaks are judged on the rows before spans go
    clean = stages["decontaminate"](spark, one, str(tmp_path))
    assert sorted((i or 0, t) for i, t in clean.select("doc_id", "text").collect()) == sorted((i or 0, t) for i, t in found if ITEM not in t)


def test_language_stage_against_a_plain_version(spark):
    from tests.llm.test_language import Plain

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("u", F.lit(1)).withColumn("n", F.lit("x")).withColumn("last", F.lit(None).cast("int"))
    rows = docs.collect()
    model = Plain([(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1])
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    want = sorted(r["doc_id"] for r in rows for lang, score in [model.predict(r["text"])] if lang != "und" and score >= 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_packing_stage_packs_every_row(spark):
    rows = [(None, "a b c"), (1, None), (1, "x y"), (1, "x y"), (2, "")]
    pieces = corpus_pipeline.packed(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["offset"], r["length"]) for r in pieces)[0][0] == 0 and len({r["sequence_id"] for r in pieces}) == 1
    assert len(pieces) == len(rows) and sum(r["length"] for r in pieces) == max(r["offset"] + r["length"] for r in pieces)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, n_chars long, node long, bucket string, key binary, digest string, row int, component string, ranges string, words string"
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0 and (name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")])
    row = lambda i, t: (i, t, "en", len(t), 1, "b", b"k", "d", 2, "c", "r", "w")
    docs = spark.createDataFrame([row(i, prose(120)) for i in range(40)] + [row(50, f"{prose(60)} {ITEM}"), row(51, "12 !")], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(40)) and docs.columns == [c.split()[0] for c in schema.split(", ")]
