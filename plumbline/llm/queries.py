"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import chunked_bpe, cotraining, dataset_manifest, hamerly, impact_search, packing, prefix_pieces, quality_rules, secret_markov, simhash_pigeonring, substring_dedup, url_markov, warc_fixity
from plumbline.llm.common import read_table


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits all pages against a rehearsal replica with faults."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc_fixity.audit(pages, warc_fixity.rehearsal(pages))


def op2_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(read_table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pigeonring.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash_pigeonring.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.apply_rules(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", *(f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op8_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_markov.summary(secret_markov.scan(docs).select("doc_id", "spans"))


def op11_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_pieces.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and a rehearsal in which some texts were changed."""
    return dataset_manifest.audit(read_table(spark, sf_dir, "documents", *dataset_manifest.COLUMNS))


def op13_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc_fixity, op2_difference_cover, op3_best_fit_packing, op4_impact_ordered_search, op5_cotrained_quality, op6_simhash_pigeonring, op7_quality_rules, op8_url_language_models, op9_chunked_bpe, op10_secret_scan, op11_prefix_pieces, op12_dataset_manifest, op13_hamerly_clusters)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_fixity": warc_fixity.oracle_sql(),
        "op2_difference_cover": substring_dedup.oracle_sql(),
        "op4_impact_ordered_search": impact_search.oracle_sql(),
        "op7_quality_rules": quality_rules.oracle_sql(),
        "op8_url_language_models": url_markov.oracle_sql(),
        "op12_dataset_manifest": dataset_manifest.oracle_sql(),
        "op13_hamerly_clusters": hamerly.oracle_sql(),
    }
