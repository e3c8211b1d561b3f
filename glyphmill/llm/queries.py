"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html, languagemodel, linededup, packing, quality, secrets, sharding, simhash, substring
from .common import read_table, small_batches


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    small_batches(spark)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the items and their overlap."""
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fertility measures and verdict of every document."""
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.rate(docs, read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "fallback_share", "token_entropy",
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, those in decoded layers included."""
    small_batches(spark)
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.span_text("base_spans"), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, digest=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line counts and a digest of the lines that stay."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that its links reach."""
    small_batches(spark)
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word counts and a digest of the words that stay."""
    small_batches(spark)
    kept = substring.drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score."""
    small_batches(spark)
    scored = languagemodel.train_and_score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, equal texts together, shards of near equal bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign_shards(docs, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_secret_scans": op10_secret_scans,
}

ORACLE: dict[str, str] = {
    "op5_line_dedup": linededup.ORACLE_SQL,
}
