"""The latent space of the leak search is fitted on every document."""

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import leaks


def test_every_document_is_fitted(spark, monkeypatch):
    fitted, fit = [], leaks.latent_space
    monkeypatch.setattr(leaks, "latent_space", lambda table, *rest: fitted.append(table.count()) or fit(table, *rest))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(500))) for k in range(12))).alias("text"))
    items = docs.filter("doc_id in (7, 29999)").select(F.col("doc_id").alias("item_id"), "text")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.benchmark_leaks(docs, items).collect()}
    assert fitted == [30_000] and found == {(7, 7), (29999, 29999)}


def test_small_corpus(spark):
    """A verbatim item is found whatever its cosine in a space that few documents span."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdeilnoprstu"), rng.integers(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = prose(40)
    rows = [(i, prose(120)) for i in range(14)] + [(20 + i, prose(120) + " " + item) for i in range(3)]
    found = leaks.benchmark_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [20, 21, 22]
