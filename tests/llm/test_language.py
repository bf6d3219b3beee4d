"""Language identification against a plain version that keeps strings in dictionaries."""

import math
import re
import zlib
from collections import Counter

from termloom.llm import langid

LETTERS = re.compile(r"[^\W\d_]+")


def plain_words(text):
    return [w for w in LETTERS.findall((text or "").lower()) if any(c.isalpha() for c in w)]


def grams(word, n):
    framed = f" {word} "
    return [g for i in range(len(framed) - n + 1) if (g := framed[i : i + n]) != " "]


class Plain:
    def __init__(self, rows):
        self.words, self.grams = {}, {}
        for text, lang in dict.fromkeys(rows):
            for w in plain_words(text):
                self.words.setdefault(lang, Counter())[w] += 1
                self.grams.setdefault(lang, Counter()).update((n, g) for n in range(1, langid.LONGEST + 1) for g in grams(w, n))
        self.langs = sorted(self.words)
        self.totals = {x: (sum(self.words[x].values()), sum(self.grams[x].values())) for x in self.langs}

    def word(self, w, lang):
        if any(w in c for c in self.words.values()):
            return math.log((self.words[lang][w] + 0.1) / (self.totals[lang][0] + 1))
        for n in range(langid.LONGEST, 0, -1):
            hits = [(n, g) for g in grams(w, n) if any((n, g) in c for c in self.grams.values())]
            if hits:
                return sum(math.log((self.grams[lang][g] + 0.1) / (self.totals[lang][1] + 1)) for g in hits) / len(hits) + langid.BACK_OFF * (langid.LONGEST - n + 1)
        return 0.0

    def predict(self, text):
        found = plain_words(text)
        if not found:
            return "und", 0.0
        s = [sum(self.word(w, x) for w in found) for x in self.langs]
        p = [math.exp(v - max(s)) for v in s]
        best = max(range(len(p)), key=lambda i: (p[i], -i))
        return self.langs[best], p[best] / sum(p)


def test_same_as_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text", "lang").collect()
    model = Plain([(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1])
    got = {r["doc_id"]: r for r in langid.document_languages(df).collect()}
    assert len(got) == len(rows) > 100
    for r in rows:
        lang, score = model.predict(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 2e-6


def test_odd_words(spark):
    """Long runs, unknown signs, ties by name, repeated rows, and a bound on the labelled texts."""
    rows = [(2, "abc abd", "b"), (2, "abc abd", "b"), (3, "abc abd", "a"), (5, "x" * 5000 + " yes", "c"), (6, "中文 字²", "d"), (7, None, "a"), (8, "12 _", "a"), (9, "zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, plain = langid.train(df), Plain([(t, x) for _, t, x in rows if t and x])
    asked = ["abc abd", "x" * 5000, "xxabc 字", "éé", "q" * 300 + " abc", "²", "", None, "中" * 200, "abc² yes"]
    for text, (lang, score) in zip(asked, model.predict(asked), strict=True):
        want = plain.predict(text)
        assert lang == want[0] and abs(score - want[1]) < 2e-6, text
    assert model.predict(["abc abd"])[0][0] == "a"
    many = spark.range(300).selectExpr("id AS doc_id", "concat('w', id % 100, ' common') AS text", "if(id % 3 = 0, 'a', 'b') AS lang")
    found = langid.fit_sample(many, 20).groupBy("lang").count().collect()
    assert sorted((r["lang"], r["count"]) for r in found) == [("a", 20), ("b", 20)]
    assert langid.fit_sample(many, 1000).count() == 200


def test_copies_cost_no_training_text(spark):
    """20,000 rows of 200 distinct texts: a bound of 200 keeps them all, a bound of 50 keeps 50."""
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('w', if(id % 3 = 0, 0, id % 200), ' common') AS text", "'a' AS lang")
    assert langid.fit_sample(many, 200).count() == 200
    assert langid.fit_sample(many, 50).select("text").distinct().count() == 50
