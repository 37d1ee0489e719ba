"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import bpe, chat_collapse, html_text, itq_neardup, line_dedup, merkle, ngram_jaccard, ordinal_quality, packing, prefix_trie, quality_rules, secret_scan, warc
from memloom.sources.tables import spread, table


def byte_bpe() -> str:
    """The vocabulary file that packing and encoding use."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and verdict of every document."""
    return ordinal_quality.classify(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "labels"))


def op4_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of every vector within its label."""
    return itq_neardup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op5_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op6_bayesian_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of every document."""
    return ngram_jaccard.near_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation as one text."""
    return chat_collapse.collapse_and_render(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(spread(table(spark, sf_dir, "documents", "doc_id", "text")), byte_bpe(), end_id=0, capacity=1024)


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives, normalised and read back."""
    records = warc.archive_and_read(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    return line_dedup.dedup_lines(spread(table(spark, sf_dir, "documents", "doc_id", "text"))).select("doc_id", "n_dropped_lines", "text")


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of the texts decoded from them."""
    ids = bpe.encode(spread(table(spark, sf_dir, "documents", "doc_id", "text")), byte_bpe())
    return bpe.decode(ids, byte_bpe()).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document."""
    return merkle.verified_manifest(spread(table(spark, sf_dir, "documents", *merkle.COVERED)))


def op13_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secrets(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ordinal_quality": op1_ordinal_quality,
        "op4_itq_near_duplicates": op4_itq_near_duplicates,
        "op5_line_block_text": op5_line_block_text,
        "op6_bayesian_ngram_join": op6_bayesian_ngram_join,
        "op2_snapshot_collapse": op2_snapshot_collapse,
        "op7_quality_rules": op7_quality_rules,
        "op8_warc_normaliser": op8_warc_normaliser,
        "op3_harmonic_packing": op3_harmonic_packing,
        "op9_segment_line_dedup": op9_segment_line_dedup,
        "op10_forced_boundary_bpe": op10_forced_boundary_bpe,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_octopus_manifest": op12_octopus_manifest,
        "op13_trigram_secrets": op13_trigram_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_snapshot_collapse": chat_collapse.DUCKDB_SQL,
        "op7_quality_rules": quality_rules.duckdb_sql(),
        "op8_warc_normaliser": WARC_SQL,
        "op11_prefix_trie": prefix_trie.DUCKDB_SQL,
        "op12_octopus_manifest": merkle.DUCKDB_SQL,
        "op13_trigram_secrets": secret_scan.duckdb_sql(),
    }


#: What comes back of the archives.
WARC_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""
