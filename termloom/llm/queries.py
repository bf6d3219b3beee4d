"""The queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import chat, jaccard, langid, leaks, licenses, media, minhash, packing, repeats, token_file, trie, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(_table(spark, sf_dir, "documents"))


#: A conversation whose texts look like control strings.
TRAP = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(turns.columns, row, strict=True))) for row in TRAP))).alias("t")).select("t.*")
    return chat.chat_digests(turns).unionByName(chat.chat_digests(trap))  # a conversation -1 of the table stays its own


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_ids(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_media_columns": op2_media_columns,
    "op3_warc": op3_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_curve_packing": op6_curve_packing,
    "op7_repeated_spans": op7_repeated_spans,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_token_ids": op10_token_ids,
    "op11_whitening": op11_whitening,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM w""",
    "op9_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                   replace(replace(replace(text, '^', '^0'), '<', '^1'), '|', '^2') AS esc,
                   replace(replace(replace(role, '^', '^0'), '<', '^1'), '|', '^2') AS esc_role
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(length(esc) + CASE WHEN before IS NULL OR before <> role THEN length(esc_role) + 8 ELSE 3 END))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_prefix_trie": """
        WITH own AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS at,
                   {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT c, count(*) AS n, c - c % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 6 AS h
            FROM own GROUP BY c),
        steps AS (
            SELECT k.c, o.at AS at, o.t FROM convs k JOIN own o ON o.c = k.base WHERE o.at < k.h
            UNION ALL SELECT k.c, o.at, o.t FROM convs k JOIN own o ON o.c = k.c WHERE o.at >= k.h),
        lists AS (SELECT k.c, coalesce((SELECT list(s.t ORDER BY s.at) FROM steps s WHERE s.c = k.c), []) AS l FROM convs k),
        paths AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM lists),
        nodes AS (SELECT d, l[1:d] AS p, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(l) = d), '') AS ends FROM paths GROUP BY d, l[1:d]),
        kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
        full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.p = k.p),
        above AS (SELECT *, unnest(range(0, d + 1)) AS up FROM full_nodes),
        rolled AS (
            SELECT up AS d, p[1:up] AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
                   sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].text) END)::BIGINT AS saved_tokens
            FROM above GROUP BY ALL)
        SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, r.n_leaves, r.saved_tokens, sha256(f.ends) AS ends_sha256
        FROM full_nodes f JOIN rolled r ON f.d = r.d AND f.p = r.p LEFT JOIN nodes u ON u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
