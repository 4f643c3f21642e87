"""A corpus from raw documents, stage by stage; each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passbook.llm import minhash, mixing, packing, pii, quality
from passbook.session import saved, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. A null text is judged as an empty
    one; rows that repeat are judged each; no rows give none, as in all stages."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, by five-word shingles. Documents without
    words, and those without an id, stay; rows that repeat the kept id stay with it."""
    return minhash.first_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; null texts stay null."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents as often as it takes them, so none without words.
    A null source is one of its own; equal hash keys go by doc_id, then size."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their token ids and sequences; rows that repeat
    are packed each."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near copies", drop_near_copies),
    ("pseudonyms", pseudonymise),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), shared_dir(spark, f"pipeline-{name.replace(' ', '-')}"))
    return STAGES[-1][1](spark, docs, sf_dir)
