"""Markdown files with front matter, as chunks under their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import chunking


def front_matter(raw: Column) -> tuple[Column, Column]:
    """The leading ``---`` block as a map of texts without quotes, and the rest of the file."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n"
    lines = F.filter(F.split(F.regexp_extract(raw, pattern, 1), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.locate(":", x) + 1)), "^[\"']+|[\"']+$", "").alias("v"))
    pairs = F.transform(lines, pair)
    # of a key that stands twice the last value counts
    distinct = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(distinct), F.regexp_replace(raw, pattern, "")


def text_list(raw: Column) -> Column:
    """``["a", "b"]`` as JSON, else parts between commas without quotes."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(raw), r"^\[+|\]+$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}), F.filter(parts, lambda x: x != "")))


def sections(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """``key``, section, breadcrumb and text: what stands under each heading; lead text has no breadcrumb."""
    lines = bodies.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("position", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    headed = lines.withColumn("level", F.when(mark != "", F.length(mark))).withColumn("title", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)))
    under = chunking.breadcrumbs(headed, key, "position", "level", "title")
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.when(F.col("level").isNull(), F.col("line")).alias("line")))), lambda x: x["line"]), "\n")
    found = under.groupBy(key, "section").agg(F.max_by("breadcrumb", F.struct(F.col("level").isNotNull(), "position")).alias("breadcrumb"), F.trim(own).alias("text"))
    return found.filter("section > 0 or trim(text) <> ''")


def read_documents(spark: SparkSession, path: str, size: int, overlap: int) -> DataFrame:
    """Every ``*.md`` file of a folder: doc_id (``stem#breadcrumb#i``), title, section, doc_type, effective_year, program_ids, text."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1).alias("stem"), "value")
    meta, body = front_matter(F.col("value"))
    docs = raw.select("stem", meta.alias("meta"), body.alias("body"))
    cut = chunking.chunked(sections(docs, "stem", "body"), "text", size, overlap)
    m = lambda k: F.col("meta")[k]
    return cut.join(docs.select("stem", "meta"), "stem").select(
        F.concat_ws("#", "stem", F.when(F.col("breadcrumb") == "", "intro").otherwise(F.col("breadcrumb")), (F.col("part") - 1).cast("string")).alias("doc_id"),
        F.coalesce(m("title"), F.col("stem")).alias("title"), F.col("breadcrumb").alias("section"), F.coalesce(m("doc_type"), F.lit("unknown")).alias("doc_type"),
        F.when(m("effective_year").rlike("^[0-9]+$"), m("effective_year").try_cast("int")).alias("effective_year"), text_list(m("program_ids")).alias("program_ids"), F.col("chunk").alias("text"),
    )
