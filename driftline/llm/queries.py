"""The `opN_*` queries on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, histogram_sort, hmm, isolation, kneser_ney, license_scan, lsh_forest, tiling, url_gbt, warc_fixity
from .shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _replica(pages: DataFrame) -> DataFrame:
    """A copy of `pages` with faults: altered, missing and additional records, at fixed places."""
    altered = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    kept = pages.select("page_id", "url", altered.alias("html")).where("page_id is null or page_id % 331 <> 7")
    extra = pages.where("page_id % 503 = 100").select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return kept.unionByName(extra)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    record = lambda t: t.select("page_id", warc_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return warc_fixity.audit(record(pages), record(_replica(pages)), "page_id", "record").withColumnRenamed("position", "page_id")


OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, html FROM pages
), b AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN '~' || coalesce(html, '') ELSE html END AS html FROM pages WHERE page_id % 331 <> 7
  UNION ALL SELECT -1 - page_id, url, html FROM pages WHERE page_id % 503 = 100
), both_ AS (
  SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b
), records AS (
  SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM both_
), hashed AS (
  SELECT side, page_id, sha256(r) AS h, CAST(strlen(r) AS BIGINT) AS n FROM records
), pairs AS (
  SELECT coalesce(x.page_id, y.page_id) AS page_id, x.h AS hash_a, y.h AS hash_b, coalesce(x.n, 0) AS bytes_a, coalesce(y.n, 0) AS bytes_b
  FROM (SELECT * FROM hashed WHERE side = 'a') x FULL JOIN (SELECT * FROM hashed WHERE side = 'b') y ON x.page_id = y.page_id
), placed AS (
  SELECT *, CAST(sum(bytes_a) OVER (ORDER BY page_id) - bytes_a AS BIGINT) AS offset_a, CAST(sum(bytes_b) OVER (ORDER BY page_id) - bytes_b AS BIGINT) AS offset_b FROM pairs
)
SELECT page_id, CASE WHEN hash_b IS NULL THEN 'missing' WHEN hash_a IS NULL THEN 'extra' ELSE 'altered' END AS kind,
  offset_a, bytes_a, offset_b, bytes_b, hash_a, hash_b
FROM placed WHERE hash_a IS DISTINCT FROM hash_b
"""


#: Quantile of the good documents of a language that the model has not seen, and room above it, in log10 of the perplexity for a token.
OP2_QUANTILE, OP2_SLACK = 0.995, 0.1


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and threshold are both log10 for a token."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = kneser_ney.perplexities(docs, kneser_ney.fit(docs, labels))
    out = kneser_ney.judge(scored, kneser_ney.thresholds(scored, labels, OP2_QUANTILE, OP2_SLACK))
    return out.select("doc_id", "lang", "n_tokens", F.round("log_ppl", 9).alias("log10_perplexity"), F.round("threshold", 9).alias("log10_threshold"), "kept")


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiling.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.withColumn("coverage", F.round("coverage", 9))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    out = histogram_sort.shards(rows, 24, "doc_id", "size", "text_hash")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(isolation.rule_table(_table(spark, sf_dir, "documents")), "rules")
    model = isolation.fit(table, _table(spark, sf_dir, "labels"))
    return isolation.judge(table, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_table(spark, sf_dir, "documents"))


#: Exact: every pair of different shingle sets that shares a shingle is compared.
OP7_SQL = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM lowered
), classes AS (
  SELECT list_sort(s) AS key, min(doc_id) AS rep, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
), inverted AS (
  SELECT rep, n, unnest(key) AS e FROM classes
), links AS (
  SELECT a.rep AS u, b.rep AS v FROM inverted a JOIN inverted b ON a.e = b.e AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT rep AS node, rep AS seen FROM classes
  UNION
  SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.seen = b.u
), named AS (
  SELECT node AS rep, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(n.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.key AND len(s.s) > 0 LEFT JOIN named n ON n.rep = c.rep
"""


def op8_license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, language and 256 ids; each 64th is a licence file, half of these one level up."""
    docs = _table(spark, sf_dir, "documents")
    top = F.concat_ws("/", "source", "lang")
    block = F.concat_ws("/", top, (F.col("doc_id") / 256).cast("long").cast("string"))
    path = F.when(F.col("doc_id") % 128 == 0, F.concat_ws("/", top, F.lit("LICENSE"))).when(F.col("doc_id") % 64 == 0, F.concat_ws("/", block, F.lit("LICENSE"))).otherwise(F.concat_ws("/", block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text")).withColumn("score", F.round("score", 9))


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(_table(spark, sf_dir, "documents"))


#: Rules of the contract: verdict and host/path.
OP10_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_gbt.filter_urls(_table(spark, sf_dir, "pages"), OP10_RULES)
    return out.withColumn("block_probability", F.round("block_probability", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fixity": op1_merkle_fixity,
        "op2_kneser_ney": op2_kneser_ney,
        "op3_string_tiling": op3_string_tiling,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_histogram_sort": op5_histogram_sort,
        "op6_isolation_rules": op6_isolation_rules,
        "op7_lsh_forest": op7_lsh_forest,
        "op8_license_inheritance": op8_license_inheritance,
        "op9_hidden_markov": op9_hidden_markov,
        "op10_boosted_urls": op10_boosted_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": OP1_SQL, "op7_lsh_forest": OP7_SQL}
