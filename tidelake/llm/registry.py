"""Queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, license_scan, lm_score, merkle, minhash, mixing, pii, quality_rules, substring_dedup, suffix_dedup, topk, toxicity, vector_codes
from .common import Scratch, ensure_checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by digests of whole texts and of lines."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model of the whole corpus."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    with Scratch(spark) as scratch:
        return lm_score.score(docs, lm_score.fit(docs, scratch)).checkpoint()


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fifth are not learnt from."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mixture of sources by the square root of their sizes."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.tempered_weights(docs)).select("doc_id", "source", "mix_block", "mix_slot", "mix_place", "mix_on_target")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and spans."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to 400-byte strings that also start elsewhere, and how much of it to ones that start earlier."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_later")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that documents share with benchmark items."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stretch="longest")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to windows of 20 words that also start earlier."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base checks and the verdict of the learned decision list for every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its row, changed where 7 divides its id's CRC-32, folds to the root."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.audit(table(spark, sf_dir, "documents"), tampered, {"n_chars": F.col("n_chars") + 1})


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of largest inner product with each query, which are the vectors whose id 50 divides."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen-part codes of every vector, with their errors."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {"op1_license_scan": op1_license_scan, "op2_lm_score": op2_lm_score, "op3_toxicity": op3_toxicity, "op4_mixing": op4_mixing, "op5_pii": op5_pii, "op6_suffix_dedup": op6_suffix_dedup, "op7_decontamination": op7_decontamination, "op8_substring_dedup": op8_substring_dedup, "op9_near_duplicates": op9_near_duplicates, "op10_quality_rules": op10_quality_rules, "op11_merkle_manifest": op11_merkle_manifest, "op12_top_k": op12_top_k, "op13_vector_codes": op13_vector_codes, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op4_mixing": mixing.oracle(), "op11_merkle_manifest": merkle.oracle(), "op12_top_k": topk.oracle(), "op13_vector_codes": vector_codes.oracle()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
