"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import (
    ann,
    binary,
    language,
    merkle,
    minhash,
    mixing,
    packing,
    pii,
    quality,
    resample,
    simhash,
    substring,
    topk,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every twentieth one, by hashing."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with pseudonyms for personal data."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that the pieces of each document are packed into."""
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", crc, "sequence_id", "offset")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, as read back from bit-packed token files."""
    return binary.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of earlier ones."""
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best vectors of every fiftieth one, exactly."""
    return topk.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of each document."""
    return minhash.cluster(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of each document, and the ranks of those drawn for the benchmark."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and its component of near ones."""
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and the check of a copy."""
    return merkle.prove(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_cross_polytope_ann": op3_cross_polytope_ann,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
