"""The queries opN_<name> over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import embed_dedup, media, packing, pieces, simhash, substring, token_counts, toxicity, urlfilter, warc
from lamella.llm.wordbpe import default_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(_table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), default_path())


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


RULES = [
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of blocked hosts holds those whose MD5 begins with 0 or 1, an eighth of all. All levels of the cascade are built by tasks, however few keys there are."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = urlfilter.host_and_path(F.col("url"))
    blocked = pages.select(host.alias("host")).distinct().filter(F.substring(F.md5(F.col("host").cast("binary")), 1, 1).isin("0", "1"))
    return urlfilter.judge(pages, RULES, blocked)


OP5_SQL = """
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN substr(md5(host), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, m::BIGINT AS component_id, vec_id = m AS kept
FROM embeddings JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = vec_id
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with passages that an earlier document has too: those documents, the spans and how many words they cover."""
    found = substring.repeated_passages(_table(spark, sf_dir, "documents"))
    per_doc = found.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.flatten(F.collect_list("spans")).alias("spans"))
    return per_doc.select("doc_id", "sources", F.size("spans").alias("n_spans"), F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs.select("doc_id", "text"), default_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_transactions, op2_best_fit_packing, op3_media_columns, op4_toxicity, op5_url_filters, op6_simhash_near_dedup, op7_sentencepiece, op8_embedding_near_dedup, op9_substring_dedup, op10_token_counts)
}
ORACLE_SQL: dict[str, str] = {"op1_warc_transactions": OP1_SQL, "op5_url_filters": OP5_SQL, "op8_embedding_near_dedup": OP8_SQL}
