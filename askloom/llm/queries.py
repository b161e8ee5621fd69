"""Registered queries of the dealt operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import (
    byte_bpe, host_paths, labelled, lev_toxicity, order_minhash, packing, permutation_index, prefix_trie, revisits,
    secret_scan, subword_quality, superminhash, url_filters, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------------------ 2 revisits
# Captures derived from each page: (k, hours after the page's first, status). The second response
# holds changed text; revisits are asked for by a variant of the URL.
CAPTURES = ((0, 0, 200), (1, 24, 304), (2, 48, 200), (3, 72, 304), (4, -24, 304))


def archive_records(pages: DataFrame) -> DataFrame:
    """Responses and not-modified revisits of every page, some with changed or missing validators."""
    k = F.col("c.k")
    at = F.expr("timestamp_seconds(1704067200 + (page_id % 1000) * 3600 + c.hours * 3600)")
    first, second = F.md5(F.coalesce("html", F.lit(""))), F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit("2")))
    tag = (
        F.when(F.col("page_id") % 4 == 3, None)
        .when(k == 0, first)
        .when(k == 1, F.when(F.col("page_id") % 5 == 0, F.lit("changed")).otherwise(first))
        .when(k == 2, second)
        .when(k == 3, F.when(F.col("page_id") % 3 == 0, first).otherwise(second))
    )
    modified = F.when(F.col("page_id") % 8 == 7, F.when(k <= 1, "day 0").otherwise(F.concat(F.lit("day "), k)))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.filter(
        F.array(
            pair("content-type", F.when(k.isin(0, 2), "text/html").cast("string")),
            pair("date", F.date_format(at, "yyyy-MM-dd HH:mm:ss")),
            pair("etag", tag), pair("last-modified", modified),
            pair("server", F.concat(F.lit("s"), k.cast("string"))),
        ),
        lambda h: h["value"].isNotNull(),
    )
    captures = F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("hours"), F.lit(s).alias("status")) for a, b, s in CAPTURES])
    return pages.select("page_id", "url", "html", F.explode(captures).alias("c")).select(
        (F.col("page_id") * 5 + k).alias("record_id"),
        F.when(F.col("c.status") == 304, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"),
        at.alias("captured_at"), F.col("c.status").alias("status"), headers.alias("headers"),
    )


_CANON = r"""
    CASE WHEN length(host) > 0 THEN
      CASE WHEN scheme = 'https' THEN 'http' ELSE scheme END || '://' || host || path ||
      CASE WHEN len(asked) > 0 THEN '?' || array_to_string(list_sort(asked), '&') ELSE '' END END"""
_SQL2 = rf"""
WITH c AS (SELECT * FROM (VALUES (0, 0, 200), (1, 24, 304), (2, 48, 200), (3, 72, 304), (4, -24, 304)) v(k, hours, status)),
raw AS (
  SELECT page_id * 5 + k AS record_id, k, page_id, status, coalesce(html, '') AS html,
         regexp_replace(url, '#.*$', '') AS bare,
         make_timestamp((1704067200 + (page_id % 1000) * 3600 + hours * 3600)::BIGINT * 1000000) AS captured_at
  FROM pages, c),
parts AS (
  SELECT *, lower(regexp_extract(bare, '^([^:/?#]+)://', 1)) AS scheme,
         regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://([^/?]*)', 1)), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^:/?#]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                     lambda p: length(p) > 0 AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')) AS asked
  FROM raw),
rec AS (
  SELECT record_id, k, page_id, status, captured_at, {_CANON} AS canonical_url,
    CASE WHEN page_id % 4 = 3 THEN NULL WHEN k = 0 THEN md5(html)
         WHEN k = 1 THEN CASE WHEN page_id % 5 = 0 THEN 'changed' ELSE md5(html) END
         WHEN k = 2 THEN md5(html || '2')
         WHEN k = 3 THEN CASE WHEN page_id % 3 = 0 THEN md5(html) ELSE md5(html || '2') END END AS etag,
    CASE WHEN page_id % 8 = 7 THEN CASE WHEN k <= 1 THEN 'day 0' ELSE 'day ' || k END END AS modified,
    strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS date, 's' || k AS server
  FROM parts),
met AS (
  SELECT r.*, f.record_id AS f_id, f.etag AS f_etag, f.modified AS f_modified, f.server AS f_server
  FROM (SELECT * FROM rec WHERE status = 304) r LEFT JOIN (SELECT * FROM rec WHERE status = 200) f
    ON r.canonical_url = f.canonical_url AND f.captured_at < r.captured_at
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.captured_at DESC, f.record_id DESC) = 1),
told AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'unresolved'
       WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'mismatch' END
       WHEN modified IS NOT NULL AND f_modified IS NOT NULL THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'mismatch' END
       ELSE 'unchecked' END AS state FROM met)
SELECT record_id, canonical_url, date AS captured_at, state,
       CASE WHEN state IN ('resolved', 'unchecked') THEN f_id END AS response_id,
       CASE WHEN state IN ('resolved', 'unchecked') THEN
         'content-type: text/html' || chr(10) || 'date: ' || date
         || CASE WHEN coalesce(etag, f_etag) IS NOT NULL THEN chr(10) || 'etag: ' || coalesce(etag, f_etag) ELSE '' END
         || CASE WHEN f_modified IS NOT NULL THEN chr(10) || 'last-modified: ' || f_modified ELSE '' END
         || chr(10) || 'server: ' || f_server END AS headers
FROM told"""


@query("op2_revisits", _SQL2)
def op2_revisits(spark, d):
    """Revisits among captures derived from every page, with the headers they resolve to."""
    out = revisits.resolve_revisits(archive_records(table(spark, d, "pages")))
    return out.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    )


# ------------------------------------------------------------------------------ 10 URL filters
RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)

_SQL10 = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')) AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, rv))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict
FROM (SELECT row_number() OVER () AS n, * FROM p)
LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC) = 1"""


@query("op10_url_filters", _SQL10)
def op10_url_filters(spark, d):
    """Every page's URL under four rules; without a rule the verdict is ``allow``."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, d, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------------------------ 9 near-duplicates
@query("op9_superminhash")
def op9_superminhash(spark, d):
    """Every document with its shingle count, component and whether it stays."""
    return superminhash.near_duplicates(table(spark, d, "documents"))


# ------------------------------------------------------------------------------ 4 quality, 5 toxicity
QUALITY_FROM = 0.3
TOXIC_FROM = 0.5


def _judged(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op4_subword_quality")
def op4_subword_quality(spark, d):
    """Quality score of every document."""
    docs = table(spark, d, "documents")
    return _judged(subword_quality.score(docs, subword_quality.train(docs, table(spark, d, "labels"))), QUALITY_FROM)


@query("op5_lev_toxicity")
def op5_lev_toxicity(spark, d):
    """Toxicity score of every document."""
    docs = table(spark, d, "documents")
    return _judged(lev_toxicity.score(docs, lev_toxicity.train(docs, table(spark, d, "labels"))), TOXIC_FROM)


# ------------------------------------------------------------------------------ 7 byte-level BPE, 8 packing
END_ID = 0


@query("op7_byte_bpe")
def op7_byte_bpe(spark, d):
    """Digests of every document's ids and of the bytes they decode to."""
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    told = byte_bpe.decode(byte_bpe.encode(table(spark, d, "documents"), tokens), tokens)
    return told.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, d):
    """Pieces of every document with their places in sequences of 2048 tokens."""
    return packed_documents(table(spark, d, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_texts(docs, byte_bpe.read_vocabulary(path), END_ID, added=byte_bpe.read_added(path))


# ------------------------------------------------------------------------------ 3 nearest neighbours
QUERY_EVERY = 50
NEIGHBOURS = 5


@query("op3_permutation_index")
def op3_permutation_index(spark, d):
    """The nearest found of every vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings")
    return permutation_index.nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), NEIGHBOURS)


# ------------------------------------------------------------------------------ 6 main text
@query("op6_host_paths")
def op6_host_paths(spark, d):
    """Main text of every page."""
    return host_paths.extract(table(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# ------------------------------------------------------------------------------ 1 Order MinHash
@query("op1_order_minhash")
def op1_order_minhash(spark, d):
    """Fingerprints of every document and of its edited text, with their likeness."""
    return order_minhash.fingerprint_edits(table(spark, d, "documents"))


# ------------------------------------------------------------------------------ 11 whitening
@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, d):
    """Every vector on the first sixteen whitened components, each distinct vector once in the fit."""
    return whitening.whiten(table(spark, d, "embeddings"))


# ------------------------------------------------------------------------------ 12 secrets
def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op12_entropy_secrets")
def op12_entropy_secrets(spark, d):
    """Spans of secrets in every document."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return secret_scan.scan(table(spark, d, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), count("entropy"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"),
    )


# ------------------------------------------------------------------------------ 13 prefix trie
@query("op13_prefix_trie", """
WITH RECURSIVE raw AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, max(p) AS n FROM raw GROUP BY c),
crc AS (  -- CRC-32 of the decimal id, one character and one bit at a time
  SELECT c, 0 AS i, 4294967295::BIGINT AS r FROM lengths
  UNION ALL
  SELECT c, i + 1, list_reduce(list_prepend(xor(r, ascii(substring(c::VARCHAR, i + 1, 1))), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
         lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
  FROM crc WHERE i < length(c::VARCHAR)),
plan AS (
  SELECT l.c, l.n, h, least(h, coalesce(b.n, 0)) AS m, l.c - l.c % 20 AS base
  FROM lengths l JOIN (SELECT c, xor(r, 4294967295) % 4 AS h FROM crc WHERE i = length(c::VARCHAR)) USING (c)
  LEFT JOIN lengths b ON b.c = l.c - l.c % 20),
turns AS (
  SELECT plan.c, p, role, text FROM plan JOIN raw ON raw.c = base AND p <= m
  UNION ALL SELECT c, m + p - h, role, text FROM raw JOIN plan USING (c) WHERE p > h),
keyed AS (SELECT c, p, text, md5(role || chr(0) || text) AS k FROM turns),
paths AS (
  SELECT c, 0 AS depth, '' AS key, NULL::VARCHAR AS parent, '' AS text FROM plan
  UNION ALL
  SELECT c, p, string_agg(k, '') OVER w, left(string_agg(k, '') OVER w, 32 * p - 32), text
  FROM keyed WINDOW w AS (PARTITION BY c ORDER BY p)),
nodes AS (
  SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^ \t-\r]+')) AS own
  FROM paths GROUP BY key),
spread AS (
  SELECT a.key, n.own, NOT EXISTS (SELECT 1 FROM nodes x WHERE x.parent = n.key) AS leaf, n.depth = a.depth + 1 AS child
  FROM nodes n JOIN nodes a ON a.depth <= n.depth AND left(n.key, 32 * a.depth) = a.key),
sums AS (
  SELECT key, count(*) FILTER (child) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM spread GROUP BY key),
last AS (
  SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM (SELECT c, arg_max(key, depth) AS key FROM paths GROUP BY c) GROUP BY key)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (key) LEFT JOIN last USING (key) LEFT JOIN nodes up ON up.key = n.parent""")
def op13_prefix_trie(spark, d):
    """Every node of the trie of conversations that begin with the first turns of their twenty's first."""
    return prefix_trie.shared_head_trie(table(spark, d, "conversations"))
