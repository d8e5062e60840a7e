"""The corpus operators over their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindergrid.llm import (
    bestfit, common, fixity, language, matroska, mixing, multiindex, orderhash, packing, passages, quality, resample, resync, vantage,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


@query
def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a WARC replica of all pages that no longer match the original."""
    records = fixity.warc_records(common.read(spark, sf_dir, "pages"))
    return fixity.audit(records, fixity.decayed(records))


SQL["op1_merkle_fixity"] = """
WITH made AS (
  SELECT page_id, url, CAST(FLOOR(page_id / 512) AS BIGINT) AS file,
    'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || COALESCE(url, '')
    || '\r\nContent-Type: application/http\r\nContent-Length: '
    || strlen('HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n' || COALESCE(html, ''))
    || '\r\n\r\n' || 'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n' || COALESCE(html, '') || '\r\n\r\n' AS record
  FROM (SELECT page_id, url, html FROM pages WHERE page_id IS NOT NULL)
), lined AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY page_id, url) - 1 AS number, strlen(record) AS length,
    SUM(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, url ROWS UNBOUNDED PRECEDING) - strlen(record) AS place
  FROM made
)
SELECT file, CAST(number AS BIGINT) AS number, CAST(place AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, page_id,
  sha256(record) AS sha256_one, sha256(left(record, length(record) - 5) || '~\r\n\r\n') AS sha256_two
FROM lined WHERE page_id % 97 = 13
"""


@query
def op2_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of at most 4096 tokens."""
    return packing.pack_documents(common.read(spark, sf_dir, "documents"))


@query
def op3_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the texts that are not held out."""
    docs = common.read(spark, sf_dir, "documents")
    return language.detect(docs, language.train(docs))


@query
def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document, fitted to the target weights."""
    found = mixing.fit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    shares = [F.col("p")[i].alias(f"p_{domain}") for i, domain in enumerate(mixing.DOMAINS)]
    return found.select(F.col("k").alias("doc_id"), "tokens", *shares, "rate")


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return orderhash.near_duplicates(common.read(spark, sf_dir, "documents"))


@query
def op6_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as sound in a Matroska file and read back through its packet table."""
    return matroska.media_features(matroska.text_media(common.read(spark, sf_dir, "documents")))


@query
def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query vector."""
    return multiindex.search(common.read(spark, sf_dir, "embeddings"))


@query
def op8_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labels that are not held out."""
    docs = common.read(spark, sf_dir, "documents")
    return quality.score_texts(docs, quality.train(docs, common.read(spark, sf_dir, "labels")))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed sequence: its documents, segments and checksums of its id and position rows."""
    rows = bestfit.pack_best_fit(common.read(spark, sf_dir, "documents"))
    return rows.select(
        "sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "starts", "cu_seqlens",
        F.crc32("input_ids").alias("input_ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32"),
    )


@query
def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats a passage of an earlier document."""
    return passages.repeated_passages(common.read(spark, sf_dir, "documents"))


@query
def op11_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds from eight centroids."""
    return vantage.vantage_clusters(common.read(spark, sf_dir, "embeddings"))


SQL["op11_vantage_clusters"] = vantage.clusters_sql()


@query
def op12_resync_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every text."""
    return resync.count_tokens(common.read(spark, sf_dir, "documents"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the longer documents, drawn towards the texts of the benchmark."""
    return resample.resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
