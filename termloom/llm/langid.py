"""Language identification: words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language. A word that no language knows backs off: its longest
known n-grams score instead, from LONGEST characters down to one, with a penalty for each step.

The model is fitted on at most FIT_ROWS distinct labelled texts of each language, whole, and keeps every word and
n-gram of them. Words and n-grams are known by 64-bit hashes in sorted arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.batches import record, slices
from termloom.llm.storage import written

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST, BACK_OFF = 5, math.log(0.4)
#: Distinct labelled texts of each language that a model is fitted on, at most; those of the smallest hashes are taken.
FIT_ROWS = 4000
#: Distinct texts drawn beyond four times FIT_ROWS, so that small bounds are reached too.
SPARE = 100
#: Scored words that a worker remembers, and the length from which words are scored anew each time.
KEPT, LONG = 200_000, 64
#: Languages up to this number are joined to rows as a broadcast table.
FEW = 10_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    """Runs of letters and of what counts as one in a word, in lower case; at least one sign is a letter."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def word_keys(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), np.uint64, len(found))


def gram_keys(found: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from LONGEST to 1: n, hashes of all n-grams of the words, each word between blanks, and the word of each."""
    code = np.frombuffer(" ".join(["", *found, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    # words share the blanks between them: word i begins at begin[i] and ends with the blank at begin[i + 1]
    begin = np.cumsum(sizes - 1) - (sizes - 1)
    h = np.zeros(len(code), np.uint64)
    levels = []
    for n in range(1, LONGEST + 1):
        h = h[: len(code) - n + 1]
        h = (h ^ code[n - 1 :]) * M1
        h ^= h >> np.uint64(29)
        count = np.maximum(sizes - n + 1, 0)
        of = np.repeat(np.arange(len(found)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]
        if n == 1:  # a blank alone says nothing
            kept = code[at] != 32
            of, at = of[kept], at[kept]
        levels.append((n, h[at] * M2, of))
    yield from reversed(levels)


def counts(labelled: DataFrame) -> DataFrame:
    """text, lang -> lang, level (0: words, n: n-grams), key, n over all rows."""
    schema = pa.schema([("lang", pa.string()), ("level", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(lang: str, level: int, keys: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
            own, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, weights=weights, minlength=len(own)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(np.full(len(own), level, np.int32)), pa.array(own.view(np.int64)), pa.array(n)], schema=schema)

        for texts, langs in slices(batches, ("text", "lang"), 1024):
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs, strict=True):
                by.setdefault(lang, []).extend(words(text))
            for lang, found in by.items():
                distinct, n = np.unique(np.array(found, object), return_counts=True) if found else ([], np.zeros(0, np.int64))
                if not len(distinct):
                    continue
                distinct = distinct.tolist()
                yield part(lang, 0, word_keys(distinct), n)
                for level, keys, of in gram_keys(distinct):
                    yield part(lang, level, keys, n[of])

    return labelled.select("text", "lang").mapInArrow(count, "lang string, level int, key long, n long").groupBy("lang", "level", "key").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of words (level 0) and n-grams (level n), a row of one value a language, by sorted keys."""

    def __init__(self, langs: list[str], table: pa.Table) -> None:
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        lang = np.array([place[x] for x in table["lang"].combine_chunks().dictionary_encode().dictionary.to_pylist()] or [0])
        which = lang[table["lang"].combine_chunks().dictionary_encode().indices.to_numpy()] if table.num_rows else np.zeros(0, np.int64)
        level, key, n = table["level"].to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
        total = np.zeros((2, len(langs)))
        np.add.at(total, ((level > 0).astype(int), which), n)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(LONGEST + 1):
            own = level == k
            keys, at = np.unique(key[own], return_inverse=True)
            score = np.zeros((len(keys), len(langs)))
            score[at, which[own]] = n[own]
            self.levels.append((keys, np.log((score + 0.1) / (total[min(k, 1)] + 1))))
        self.forget()

    def _look(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the level has, and where those are."""
        own = self.levels[level][0]
        if not len(own):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        hit = own[at] == keys
        return hit, at[hit]

    def score(self, found: list[str]) -> np.ndarray:
        """A row for each word."""
        out = np.zeros((len(found), len(self.langs)))
        hit, at = self._look(0, word_keys(found))
        out[hit] = self.levels[0][1][at]
        left = np.flatnonzero(~hit)
        if not len(left):
            return out
        open_words = np.ones(len(left), bool)
        for n, keys, of in gram_keys([found[i] for i in left]):
            own = open_words[of]
            keys, of = keys[own], of[own]
            hit, at = self._look(n, keys)
            if not hit.any():
                continue
            of = of[hit]
            here, begin, size = np.unique(of, return_index=True, return_counts=True)
            out[left[here]] = np.add.reduceat(self.levels[n][1][at], begin, axis=0) / size[:, None] + BACK_OFF * (LONGEST - n + 1)
            open_words[here] = False
        return out

    def forget(self) -> None:
        """Drop the scores of words met so far; tasks do so when they end, as other operators use the same workers."""
        self.known, self.scores = {}, np.zeros((0, len(self.langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability; ``und`` and 0 without letters. Of languages with equal scores the first by name."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        split = [words(t) for t in texts]
        if len(self.known) > KEPT:
            self.forget()
        fresh = sorted({w for found in split for w in found if len(w) <= LONG and w not in self.known})
        if fresh:
            begin = len(self.known)
            if begin + len(fresh) > len(self.scores):
                self.scores = np.vstack([self.scores[:begin], np.zeros((begin + 2 * len(fresh), len(self.langs)))])
            self.scores[begin : begin + len(fresh)] = self.score(fresh)
            self.known.update(zip(fresh, range(begin, begin + len(fresh)), strict=True))
        out = []
        for found in split:
            if not found:
                out.append(("und", 0.0))
                continue
            at = np.fromiter((self.known.get(w, -1) for w in found), np.int64, len(found))
            total = self.scores[at[at >= 0]].sum(axis=0)
            if (at < 0).any():
                total = total + self.score([w for w, i in zip(found, at, strict=True) if i < 0]).sum(axis=0)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            out.append((self.langs[best], round(float(p[best] / p.sum()), 6)))
        return out


def fit_sample(labelled: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, lang: at most ``rows`` distinct texts of each language, all of them where there are no more.

    Texts are ranked by a hash. Those beyond about four times the wanted rank, told by the number of distinct hashes of
    the language, are left out before texts are shuffled, and copies are merged on the map side first, so neither a
    frequent language nor a text of many copies gathers in a task.
    """
    own = labelled.filter("text is not null and lang is not null").select("lang", "text", (F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(2.0**53)).alias("u"))
    sizes = written(own.groupBy("lang").agg(F.count_distinct("u").alias("n")), "language-sizes")
    known = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    chosen = written(own.join(known, "lang").filter(F.col("u") < F.lit(4.0 * rows + SPARE) / F.col("n")).groupBy("lang", "u").agg(F.first("text").alias("text")), "labelled")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    last = chosen.select("lang", "u").withColumn("rank", rank).filter(F.col("rank") <= rows).groupBy("lang").agg(F.max("u").alias("last"))
    return chosen.join(last, "lang").filter("u <= last").select("text", "lang")


def train(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The counts are at most those of ``rows`` texts a language; languages without words are no languages of the model."""
    table = counts(fit_sample(labelled, rows)).toArrow()
    return Model(sorted(set(table["lang"].to_pylist())), table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score for every row; ``und`` with score 0 where a text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, ("doc_id", "text")):
            yield record(schema, [(i, *p) for i, p in zip(ids, shared.value.predict(texts), strict=True)])
        shared.value.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str) -> Column:
    """Documents that training never sees."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train_on(docs: DataFrame) -> Model:
    return train(docs.filter(~F.coalesce(held_out("doc_id"), F.lit(False))))


def document_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all. A null doc_id is not held out.

    Repeated rows are predicted each, and learned from once. An empty table gives an empty table; other columns than
    doc_id, text and lang are ignored.
    """
    return identify(docs, train_on(docs)).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is certain to ``least``; without a model, those with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                if shared.value.langs:
                    kept = [lang != "und" and score >= least for lang, score in shared.value.predict(texts)]
                else:
                    kept = [bool(words(t)) for t in texts]
                yield part.filter(pa.array(kept, pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(choose, docs.schema)
