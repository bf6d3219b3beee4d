"""Text, retrieval and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import ranking
from termloom.operators import retrieval as R
from termloom.plans import stored
from termloom.sources import table

#: Keywords of intents, in the order that decides ties.
INTENTS = [("ask", "what"), ("ask", "how"), ("plan", "plan"), ("plan", "make"), ("rule", "the"), ("rule", "is")]
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def doc_dedup(spark, sf):
    """Documents with equal first 160 characters, blanks and punctuation aside: the smallest id stays."""
    docs = table(spark, sf, "documents").select("doc_id", F.left(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), F.lit(160)).alias("print"))
    g = docs.groupBy("print").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"))
    return docs.join(g.filter("n > 1"), "print").filter("doc_id <> kept").select("doc_id", "kept")


def doc_chunks_fixed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(X.chunks(F.col("text"), 420, 80)).alias("chunk"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(F.length("chunk")), 4).alias("mean_chars"), F.min(F.length("chunk")).alias("shortest"), F.max(F.length("chunk")).alias("longest"))


def _index(spark, sf):
    """Postings of all documents, written once, and one row of their number and mean length."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = stored(R.postings(docs, "doc_id", X.tokens(F.col("text"))), "postings")
    lengths = index.groupBy("doc_id").agg(F.first("length").alias("length")).agg(F.sum("length").alias("total"))
    return index, docs.agg(F.count("*").alias("n"), F.count("text").alias("texts")).crossJoin(lengths).select("n", (F.coalesce("total", F.lit(0)) / F.col("texts")).alias("mean_length"))  # one row each


def _hits(spark, sf, asked):
    """As _index, but only of terms that are asked for; lengths are those of whole documents."""
    docs = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t")).select("doc_id", "t", F.size("t").alias("length"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.when(F.col("t").isNotNull(), F.col("length"))).alias("mean_length"))
    terms = docs.select("doc_id", "length", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    return stored(terms.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf")), "hits"), stats


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))


def doc_tf(spark, sf):
    index, _ = _index(spark, sf)
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))


def bm25_topk(spark, sf):
    asked = _questions(spark, sf)
    index, stats = _hits(spark, sf, asked)
    found = R.top(R.bm25(index, asked, stats, "doc_id", "item_id"), "item_id", "doc_id", 5)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _cosine(spark, sf, index, stats, weigh=R.tfidf):
    asked = table(spark, sf, "benchmark").select("item_id", "text")
    q = R.postings(asked, "item_id", X.tokens(F.col("text")))
    df = R.frequencies(index)
    return R.cosine(weigh(q, df, stats, "item_id"), weigh(index, df, stats, "doc_id"), "item_id", "doc_id")


def tfidf_cosine_topk(spark, sf):
    return R.top(_cosine(spark, sf, *_index(spark, sf)), "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tfidf_lab_topk(spark, sf):
    """Logarithmic term weights with BM25's idf."""
    return R.top(_cosine(spark, sf, *_index(spark, sf), R.tfidf_log), "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def rrf_hybrid(spark, sf):
    """BM25 and cosine fused by rank; the cosine gates the answer."""
    asked = R.postings(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", X.tokens(F.col("text")))
    best = stored(ranking.best_words(table(spark, sf, "documents"), "doc_id", "text", asked, "item_id", 20, ("bm25", "tfidf")), "best")
    words, near = (R.top(best.filter(F.col("kind") == kind), "item_id", "doc_id", 20) for kind in ("bm25", "tfidf"))
    fused = R.top(R.fuse([(words, 1.0), (near, 0.9)], "item_id", "doc_id"), "item_id", "doc_id", 5)
    return fused.join(near.select("item_id", "doc_id", F.col("score").alias("cosine")), ["item_id", "doc_id"], "left").select("item_id", "doc_id", "rank", F.round("score", 6).alias("fused"), F.round(F.coalesce("cosine", F.lit(0.0)), 4).alias("cosine"))


def ir_metrics(spark, sf):
    """Documents whose id is divisible by 50, the stated query set, are asked for by their first words; are they found?"""
    asked = table(spark, sf, "documents").filter("doc_id % 50 = 0").select("doc_id", X.tokens(F.left("text", F.lit(120))).alias("t")).filter("size(t) > 0")
    q = R.postings(asked.select(F.col("doc_id").alias("query"), "t"), "query", F.col("t"))
    found = R.top(ranking.best_words(table(spark, sf, "documents"), "doc_id", "text", q, "query", 5, ("bm25",)), "query", "doc_id", 5)
    golden = asked.select(F.col("doc_id").alias("query"), "doc_id")
    return R.metrics(found, golden, "query", "doc_id", 5)


def ablation_grid(spark, sf):
    """Metrics of each configuration: words, vectors, both, and both with other weights."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), X.tokens(F.left("text", F.lit(120))).alias("t")).filter("size(t) > 0")
    best = ranking.best_words(docs, "doc_id", "text", R.postings(asked, "query", F.col("t")), "query", 10, ("bm25", "tfidf"))
    best = stored(R.top(best.withColumn("of", F.struct("kind", "query")), "of", "doc_id", 10).drop("of"), "best")
    words, near = (best.filter(F.col("kind") == kind) for kind in ("bm25", "tfidf"))
    golden = asked.select("query", F.col("query").alias("doc_id"))
    grid = {"bm25": words, "tfidf": near, "hybrid": R.top(R.fuse([(words, 1.0), (near, 1.0)], "query", "doc_id"), "query", "doc_id", 10), "hybrid_090": R.top(R.fuse([(words, 1.0), (near, 0.9)], "query", "doc_id"), "query", "doc_id", 10), "hybrid_045": R.top(R.fuse([(words, 1.0), (near, 0.45)], "query", "doc_id"), "query", "doc_id", 10)}
    parts = [R.metrics(found, golden, "query", "doc_id", 5).withColumn("config", F.lit(name)) for name, found in grid.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rerank_grounding(spark, sf):
    """The ten best documents of each item by BM25, put in order again by what they really hold of its words.

    A document's first line is its title. Coverage is the share of the item's idf that the document's words have;
    grounding says whether there is evidence at all.
    """
    asked = _questions(spark, sf)
    index, stats = _hits(spark, sf, asked)
    first = R.top(R.bm25(index, asked, stats, "doc_id", "item_id"), "item_id", "doc_id", 10).select("item_id", "doc_id", F.col("score").alias("first"), F.col("rank").alias("rank_before"))
    idf = asked.select("term").distinct().join(R.frequencies(index), "term", "left").crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5)).alias("idf"))
    weights = stored(asked.join(idf, "term"), "question-weights")
    total = weights.groupBy("item_id").agg(F.sum("idf").alias("total"))
    hit = first.join(weights, "item_id").join(index.select("doc_id", "term"), ["doc_id", "term"]).groupBy("item_id", "doc_id").agg(F.sum("idf").alias("hit"), F.count("*").alias("terms"))
    size = weights.groupBy("item_id").agg(F.count("*").alias("n_terms"))
    texts = table(spark, sf, "documents").select("doc_id", F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    items = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("q"))
    joined = first.join(hit, ["item_id", "doc_id"]).join(total, "item_id").join(size, "item_id").join(texts, "doc_id").join(items, "item_id")
    best = F.max("first").over(Window.partitionBy("item_id"))
    title = F.when(F.col("title") == F.col("q"), 1.0).when(F.contains("title", "q") & (F.length("q") >= 3), 0.85).when(F.contains("q", "title") & (F.length("title") >= 4), 0.75).otherwise(0.0)
    scored = joined.withColumns({"cov": F.col("hit") / F.col("total"), "norm": F.col("first") / best, "t": title, "exact": F.col("terms") / F.col("n_terms")})
    scored = scored.withColumn("score", F.round(F.least(F.lit(1.0), F.col("cov") * (0.60 + 0.15 * F.col("norm")) + 0.30 * F.col("t") + 0.18 * F.col("exact")), 6)).withColumn("grounding", F.round(F.least(F.lit(1.0), F.col("cov") + 0.35 * F.col("t") + 0.22 * F.col("exact")), 6))
    after = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "rank_before"))
    return scored.withColumn("rank_after", after).select("item_id", "doc_id", "score", "grounding", "rank_before", "rank_after", (F.col("rank_before") - F.col("rank_after")).alias("moved"))


def sparse_vectors(spark, sf):
    """Each item as sorted arrays of vocabulary ids and weights; ids number the items' terms in alphabetical order."""
    index = R.postings(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", X.tokens(F.col("text")))
    # the vocabulary of the stated query set; numbered in one task, a row a term
    ids = index.select("term").distinct().withColumn("id", F.row_number().over(Window.orderBy("term")) - 1)
    own = index.join(ids, "term").select("item_id", F.struct("id", F.round(F.col("tf") / F.col("length"), 6).alias("w")).alias("p")).groupBy("item_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return own.select("item_id", F.array_join(F.transform("p", lambda x: x["id"].cast("string")), ",").alias("indices"), F.array_join(F.transform("p", lambda x: F.format_number(x["w"], 6)), ",").alias("weights"))


def ngram_cosine(spark, sf):
    """Cosine of the counts of 2- and 3-grams of letters and digits, of each item with every document: the three best."""
    near = ranking.best_grams(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", 3)
    return R.top(near, "item_id", "doc_id", 3).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _gram_counts(df, key):
    own = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    return df.select(key, F.explode(F.concat(X.ngrams(own, 2), X.ngrams(own, 3))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("w"))


def doc_ngrams(spark, sf):
    """How often each 2- and 3-gram stands in all texts."""
    return _gram_counts(table(spark, sf, "documents").select(F.lit(0).alias("k"), "text"), "k").select(F.col("term").alias("gram"), F.col("w").cast("long").alias("n"))


def embedding_topk(spark, sf):
    """Nearest vectors of the rows whose id is divisible by 50, a stated query set, by cosine."""
    v = table(spark, sf, "embeddings")
    return R.nearest(v, v.filter("vec_id % 50 = 0"), "vec_id", "embedding", "query_id", 5).withColumn("score", F.round("score", 5))


def metadata_filter(spark, sf):
    """A null label passes."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").filter((F.col("lang") == "en") & (F.col("quality").isNull() | (F.col("quality") == 1))).groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))


def pii_scrub(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", X.scrub(F.col("text")).alias("t"))
    tag = lambda t: F.size(F.split("t", t)) - 1
    return s.select("doc_id", tag(r"\[EMAIL\]").alias("emails"), tag(r"\[PHONE\]").alias("phones"), tag(r"\[STUDENT_ID\]").alias("ids"), tag(r"Bearer \[REDACTED\]").alias("tokens"), F.md5(F.col("t").cast("binary")).alias("digest"))


def intent_scores(spark, sf):
    turns = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.lower("text").alias("t"))
    words = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("intent"), F.lit(w).alias("word")) for i, (a, w) in enumerate(INTENTS)))).alias("k")).select("k.*")
    hits = turns.join(F.broadcast(words), F.contains("t", "word")).groupBy("conv_id", "turn", "intent").agg(F.count("*").alias("n"), F.min("place").alias("place"))  # the keyword table is a constant
    w = Window.partitionBy("conv_id", "turn")
    best = hits.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "place"))).filter("rn = 1")
    return best.select("conv_id", "turn", "intent", F.round(F.least(F.lit(0.95), F.col("n") / F.col("total") + 0.3), 2).alias("confidence"))


def history_trim(spark, sf):
    """The newest turns whose tokens (a quarter of the characters) fit a budget of 200."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, sf, "conversations").withColumn("used", F.sum(F.floor(F.length("text") / 4)).over(w))
    return t.filter("used <= 200").groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("from_turn"), F.max("used").alias("tokens"))


def history_last_n(spark, sf):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").filter("role <> 'system'").withColumn("rn", rn).filter("rn <= 3").select("conv_id", "turn", "role")


def faithfulness(spark, sf):
    """The share of an assistant's tokens that stand in the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", X.tokens(F.col("text")).alias("own"), F.lag(X.tokens(F.col("text"))).over(w).alias("before"))
    a = t.filter("role = 'assistant' and before is not null and size(own) > 0")
    return a.select("conv_id", "turn", F.round(F.size(F.filter("own", lambda x: F.array_contains("before", x))) / F.size("own"), 6).alias("share"))


def chat_outcome(spark, sf):
    """One terminal state a conversation, from its ordered turns."""
    last = F.max_by("role", "turn")
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(last.alias("last_role"), F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return t.select("conv_id", F.when(F.col("answers") == 0, "cancelled").when(F.col("last_role") == "assistant", "complete").otherwise("interrupted").alias("status"), "n")


def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(links).alias("n_links"), F.size(F.array_distinct(links)).alias("n_distinct"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).alias("n_paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def codes_scalar(spark, sf):
    code = F.concat(F.lit(" c"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("–62 "))
    norm = X.normal_code(code)
    credit = X.credits(F.concat(F.col("p_size").cast("string"), F.lit(" (2-1-3)")))
    return table(spark, sf, "part").select("p_partkey", norm.alias("code"), X.base_code(norm).alias("base"), F.substring_index(norm, "-", -1).alias("section"), credit["total"].alias("total"), credit["self"].alias("self"), X.clean(F.concat(F.lit("  "), F.col("p_name"), F.lit("   x "))).alias("clean"), F.left("p_name", F.lit(6)).alias("title"), X.looks_like_id(F.lpad(F.col("p_partkey").cast("string"), 10, "1")).alias("id_like"))


def synonym_expand(spark, sf):
    """Members of a synonym group that are missing from a text join it."""
    groups = [["the", "this"], ["is", "was"], ["of", "in"]]
    t = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", X.tokens(F.col("text")).alias("t"))
    added = F.flatten(F.array(*(F.when(F.arrays_overlap("t", F.array(*map(F.lit, g))), F.array_except(F.array(*map(F.lit, g)), "t")).otherwise(F.array().cast("array<string>")) for g in groups)))
    return t.select("conv_id", "turn", F.array_join(added, " ").alias("added"))


def fuzzy_search(spark, sf):
    """Exact name 100, name within the query or the other way 80, else edit similarity; the stand-in for a fuzzy ratio."""
    q = F.lit("part#100")
    name = F.lower("p_name")
    score = F.when(name == q, 100.0).when(F.contains(name, q), 80.0).otherwise(F.round(100 * (1 - F.levenshtein(name, q) / F.greatest(F.length(name), F.length(q))), 4))
    return table(spark, sf, "part").select("p_partkey", score.alias("score")).filter("score >= 50").orderBy(F.desc("score"), "p_partkey").limit(20)


def answer_text(spark, sf):
    """The three best documents of each item, cut and numbered, or a refusal below the threshold."""
    best = R.top(_cosine(spark, sf, *_index(spark, sf)), "item_id", "doc_id", 3).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.left("text", F.lit(60)))
    g = best.groupBy("item_id").agg(F.max("score").alias("s"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return g.select("item_id", F.when(F.col("s") < 0.21, "refused").otherwise("answered").alias("status"), F.when(F.col("s") >= 0.21, F.col("body")).alias("answer"))


QUERIES = {f.__name__: f for f in (doc_dedup, doc_chunks_fixed, doc_ngrams, doc_tf, bm25_topk, tfidf_cosine_topk, tfidf_lab_topk, rrf_hybrid, rerank_grounding, ir_metrics, ablation_grid, sparse_vectors, ngram_cosine, embedding_topk, metadata_filter, pii_scrub, intent_scores, history_trim, history_last_n, faithfulness, chat_outcome, html_links, codes_scalar, synonym_expand, fuzzy_search, answer_text)}

_INDEX = f"tk AS (SELECT doc_id, {TOKENS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM tk), tf AS (SELECT doc_id, len(t) AS length, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tk) GROUP BY doc_id, t, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"
_BM25 = "b AS (SELECT {q}, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"
_QUESTIONS = f"q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark)"
_COSINE = f"dw AS (SELECT doc_id, term, tf / length * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), st), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1), qt AS (SELECT item_id, {TOKENS} AS t FROM benchmark), qf AS (SELECT item_id, len(t) AS length, term, count(*) AS tf FROM (SELECT item_id, t, unnest(t) AS term FROM qt) GROUP BY item_id, t, term), qw AS (SELECT item_id, term, tf / length * coalesce(ln((n + 1) / (df + 1)) + 1, 1) AS w FROM qf LEFT JOIN df USING (term), st), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1), c AS (SELECT item_id, doc_id, sum(qw.w / qn.norm * dw.w / dn.norm) AS score FROM qw JOIN qn USING (item_id) JOIN dw USING (term) JOIN dn USING (doc_id) GROUP BY 1, 2)"
_TOP = "SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {t} WHERE score > 0"
_SCRUB = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g'), '\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b', '[JWT]', 'g'),
    '\b0\d{1,2}-?\d{3}-?\d{4}\b', '[PHONE]', 'g'), '\b\d{10}\b', '[STUDENT_ID]', 'g'), '\b\d{13}\b', '[STUDENT_ID]', 'g'), '\b\d{12}-\d\b', '[STUDENT_ID]', 'g'),
    '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', '[EMAIL]', 'g')"""
_LAB = _COSINE.replace("tf / length * (ln((n + 1) / (df + 1)) + 1)", "(1 + ln(tf)) * ln(1 + (n - df + 0.5) / (df + 0.5))").replace("tf / length * coalesce(ln((n + 1) / (df + 1)) + 1, 1)", "(1 + ln(tf)) * coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), 0)")
_GRAMS = "SELECT {key}, term, count(*)::DOUBLE AS w FROM (SELECT {key}, unnest(list_concat(CASE WHEN length(s) BETWEEN 1 AND 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) END, CASE WHEN length(s) BETWEEN 1 AND 2 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)) END)) AS term FROM (SELECT {key}, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM {t})) GROUP BY 1, 2"
_ASKED50 = "a AS (SELECT doc_id AS query, regexp_extract_all(lower(left(text, 120)), '[a-z0-9]+') AS t FROM documents WHERE doc_id % 50 = 0), q AS (SELECT DISTINCT query, unnest(t) AS term FROM a)"
_METRICS = "count(*) AS queries, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS hit, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg"
_IDF = "ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))"
ORACLE_SQL = {
    "doc_dedup": "WITH d AS (SELECT doc_id, left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 160) AS p FROM documents) SELECT doc_id, kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS kept FROM d) WHERE doc_id <> kept",
    "doc_chunks_fixed": "WITH c AS (SELECT doc_id, substring(text, CAST(i * 340 + 1 AS BIGINT), 420) AS chunk FROM documents, range(0, 1000) t(i) WHERE i <= greatest(0, ceil((length(text) - 420) / 340.0))) SELECT doc_id, count(*) AS n, round(avg(length(chunk)), 4) AS mean_chars, min(length(chunk)) AS shortest, max(length(chunk)) AS longest FROM c WHERE trim(chunk) <> '' GROUP BY 1",
    "doc_ngrams": f"SELECT term AS gram, CAST(sum(w) AS BIGINT) AS n FROM ({_GRAMS.format(key='doc_id', t='documents')}) GROUP BY 1",
    "doc_tf": f"WITH {_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS most FROM tf GROUP BY 1",
    "tfidf_lab_topk": f"WITH {_INDEX}, {_LAB} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_TOP.format(q='item_id', t='c')}) WHERE rank <= 5",
    "ngram_cosine": f"WITH a AS ({_GRAMS.format(key='item_id', t='benchmark')}), b AS ({_GRAMS.format(key='doc_id', t='documents')}), na AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM b GROUP BY 1), c AS (SELECT item_id, doc_id, sum(a.w / na.n * b.w / nb.n) AS score FROM a JOIN b USING (term) JOIN na USING (item_id) JOIN nb USING (doc_id) GROUP BY 1, 2) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_TOP.format(q='item_id', t='c')}) WHERE rank <= 3",
    "sparse_vectors": f"WITH t AS (SELECT item_id, {TOKENS} AS t FROM benchmark), f AS (SELECT item_id, len(t) AS length, term, count(*) AS tf FROM (SELECT item_id, t, unnest(t) AS term FROM t) GROUP BY item_id, t, term), v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM f)) SELECT item_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS indices, string_agg(printf('%.6f', round(tf / length, 6)), ',' ORDER BY id) AS weights FROM f JOIN v USING (term) GROUP BY 1",
    "rerank_grounding": f"WITH {_INDEX}, {_QUESTIONS}, {_BM25.format(q='item_id')}, f AS (SELECT item_id, doc_id, score AS first, rank FROM ({_TOP.format(q='item_id', t='b')}) WHERE rank <= 10), w AS (SELECT item_id, term, {_IDF} AS idf FROM q LEFT JOIN df USING (term), st), tt AS (SELECT item_id, sum(idf) AS total, count(*) AS n_terms FROM w GROUP BY 1), h AS (SELECT f.item_id, f.doc_id, sum(idf) AS hit, count(*) AS terms FROM f JOIN w USING (item_id) JOIN tf ON tf.doc_id = f.doc_id AND tf.term = w.term GROUP BY 1, 2), j AS (SELECT f.item_id, f.doc_id, rank, hit / total AS cov, first / max(first) OVER (PARTITION BY f.item_id) AS norm, terms / n_terms AS exact, lower(split_part(d.text, chr(10), 1)) AS title, lower(k.text) AS qq FROM f JOIN h USING (item_id, doc_id) JOIN tt USING (item_id) JOIN documents d USING (doc_id) JOIN benchmark k USING (item_id)), s AS (SELECT *, CASE WHEN title = qq THEN 1.0 WHEN contains(title, qq) AND length(qq) >= 3 THEN 0.85 WHEN contains(qq, title) AND length(title) >= 4 THEN 0.75 ELSE 0.0 END AS t FROM j), r AS (SELECT item_id, doc_id, rank AS rank_before, round(least(1.0::DOUBLE, cov * (0.60 + 0.15 * norm) + 0.30 * t + 0.18 * exact), 6) AS score, round(least(1.0::DOUBLE, cov + 0.35 * t + 0.22 * exact), 6) AS grounding FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank_before) AS rank_after FROM r) SELECT *, rank_before - rank_after AS moved FROM o",
    "ablation_grid": f"WITH {_INDEX}, {_ASKED50}, {_BM25.format(q='query')}, qf AS (SELECT query, len(t) AS length, term, count(*) AS tf FROM (SELECT query, t, unnest(t) AS term FROM a) GROUP BY query, t, term), qw AS (SELECT query, term, tf / length * coalesce(ln((n + 1) / (df + 1)) + 1, 1) AS w FROM qf LEFT JOIN df USING (term), st), qn AS (SELECT query, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1), dw AS (SELECT doc_id, term, tf / length * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), st), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1), c AS (SELECT query, doc_id, sum(qw.w / qn.norm * dw.w / dn.norm) AS score FROM qw JOIN qn USING (query) JOIN dw USING (term) JOIN dn USING (doc_id) GROUP BY 1, 2), bt AS (SELECT query, doc_id, rank FROM ({_TOP.format(q='query', t='b')}) WHERE rank <= 10), ct AS (SELECT query, doc_id, rank FROM ({_TOP.format(q='query', t='c')}) WHERE rank <= 10), wt(config, x) AS (VALUES ('hybrid', 1.0::DOUBLE), ('hybrid_090', 0.9), ('hybrid_045', 0.45)), fu AS (SELECT config, query, doc_id, sum(p) AS score FROM (SELECT config, query, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM bt, wt UNION ALL SELECT config, query, doc_id, x / (60 + rank) FROM ct, wt) GROUP BY 1, 2, 3), ft AS (SELECT config, query, doc_id, row_number() OVER (PARTITION BY config, query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fu), al AS (SELECT 'bm25' AS config, * FROM bt UNION ALL SELECT 'tfidf', * FROM ct UNION ALL SELECT * FROM ft), g AS (SELECT config, a.query FROM a, (SELECT DISTINCT config FROM al) WHERE len(a.t) > 0), r AS (SELECT g.config, CASE WHEN rank <= 5 THEN rank END AS rank FROM g LEFT JOIN al ON al.config = g.config AND al.query = g.query AND al.doc_id = g.query) SELECT config, {_METRICS} FROM r GROUP BY 1",
    "bm25_topk": f"WITH {_INDEX}, {_QUESTIONS}, {_BM25.format(q='item_id')} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_TOP.format(q='item_id', t='b')}) WHERE rank <= 5",
    "tfidf_cosine_topk": f"WITH {_INDEX}, {_COSINE} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_TOP.format(q='item_id', t='c')}) WHERE rank <= 5",
    "rrf_hybrid": f"WITH {_INDEX}, {_QUESTIONS}, {_BM25.format(q='item_id')}, {_COSINE}, bt AS (SELECT * FROM ({_TOP.format(q='item_id', t='b')}) WHERE rank <= 20), ct AS (SELECT * FROM ({_TOP.format(q='item_id', t='c')}) WHERE rank <= 20), f AS (SELECT item_id, doc_id, sum(p) AS score FROM (SELECT item_id, doc_id, 1.0 / (60 + rank) AS p FROM bt UNION ALL SELECT item_id, doc_id, 0.9 / (60 + rank) FROM ct) GROUP BY 1, 2) SELECT f.item_id, f.doc_id, f.rank, round(f.score, 6) AS fused, round(coalesce(ct.score, 0), 4) AS cosine FROM ({_TOP.format(q='item_id', t='f')}) f LEFT JOIN ct ON ct.item_id = f.item_id AND ct.doc_id = f.doc_id WHERE f.rank <= 5",
    "ir_metrics": f"WITH {_INDEX}, {_ASKED50}, {_BM25.format(q='query')}, f AS (SELECT * FROM ({_TOP.format(q='query', t='b')}) WHERE rank <= 5), r AS (SELECT a.query, f.rank FROM a LEFT JOIN f ON f.query = a.query AND f.doc_id = a.query WHERE len(a.t) > 0) SELECT {_METRICS} FROM r",
    "embedding_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p) WHERE rank <= 5",
    "metadata_filter": "SELECT source, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND (quality IS NULL OR quality = 1) GROUP BY 1",
    "pii_scrub": f"WITH s AS (SELECT doc_id, {_SCRUB} AS t FROM documents) SELECT doc_id, len(string_split(t, '[EMAIL]')) - 1 AS emails, len(string_split(t, '[PHONE]')) - 1 AS phones, len(string_split(t, '[STUDENT_ID]')) - 1 AS ids, len(string_split(t, 'Bearer [REDACTED]')) - 1 AS tokens, md5(t) AS digest FROM s",
    "intent_scores": "WITH k(place, intent, word) AS (VALUES " + ", ".join(f"({i}, '{a}', '{w}')" for i, (a, w) in enumerate(INTENTS)) + "), h AS (SELECT conv_id, turn, intent, count(*) AS n, min(place) AS place FROM conversations, k WHERE role = 'user' AND contains(lower(text), word) GROUP BY 1, 2, 3), b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS total, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, place) AS rn FROM h) SELECT conv_id, turn, intent, round(least(0.95, n / total + 0.3), 2) AS confidence FROM b WHERE rn = 1",
    "history_trim": "WITH t AS (SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) SELECT conv_id, count(*) AS kept, min(turn) AS from_turn, max(used) AS tokens FROM t WHERE used <= 200 GROUP BY 1",
    "history_last_n": "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "faithfulness": f"WITH t AS (SELECT conv_id, turn, role, {TOKENS} AS own, lag({TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, round(len(list_filter(own, lambda x: list_contains(before, x))) / len(own), 6) AS share FROM t WHERE role = 'assistant' AND before IS NOT NULL AND len(own) > 0",
    "chat_outcome": "SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'cancelled' WHEN arg_max(role, turn) = 'assistant' THEN 'complete' ELSE 'interrupted' END AS status, count(*) AS n FROM conversations GROUP BY 1",
    "html_links": "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS n_distinct, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "codes_scalar": "SELECT p_partkey, 'C' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-62' AS code, 'C' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS base, '62' AS section, CAST(p_size AS INT) AS total, 3 AS self, trim(regexp_replace(p_name || ' x', '\\s+', ' ', 'g')) AS clean, left(p_name, 6) AS title, true AS id_like FROM part",
    "synonym_expand": f"WITH t AS (SELECT conv_id, turn, {TOKENS} AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string(list_concat(CASE WHEN list_has_any(t, ['the', 'this']) THEN list_filter(['the', 'this'], lambda x: NOT list_contains(t, x)) ELSE [] END, list_concat(CASE WHEN list_has_any(t, ['is', 'was']) THEN list_filter(['is', 'was'], lambda x: NOT list_contains(t, x)) ELSE [] END, CASE WHEN list_has_any(t, ['of', 'in']) THEN list_filter(['of', 'in'], lambda x: NOT list_contains(t, x)) ELSE [] END)), ' ') AS added FROM t",
    "fuzzy_search": "SELECT p_partkey, CASE WHEN lower(p_name) = 'part#100' THEN 100.0 WHEN contains(lower(p_name), 'part#100') THEN 80.0 ELSE round(100 * (1 - levenshtein(lower(p_name), 'part#100') / greatest(length(p_name), 8)), 4) END::DOUBLE AS score FROM part WHERE score >= 50 ORDER BY score DESC, p_partkey LIMIT 20",
    "answer_text": f"WITH {_INDEX}, {_COSINE}, b AS (SELECT * FROM ({_TOP.format(q='item_id', t='c')}) JOIN documents USING (doc_id) WHERE rank <= 3) SELECT item_id, CASE WHEN max(score) < 0.21 THEN 'refused' ELSE 'answered' END AS status, CASE WHEN max(score) >= 0.21 THEN string_agg(rank || '. ' || left(text, 60), chr(10) ORDER BY rank) END AS answer FROM b GROUP BY 1",
}
