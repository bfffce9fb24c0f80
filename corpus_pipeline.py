"""A pipeline over documents: language, near-duplicates, benchmark passages, secrets, tokens.

Each stage works on what the one before kept, and all but the last return the columns of documents. Rows with
null or empty text are rejected by the first stage; repeated rows fall to the second.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe_codec, decontaminate, language_id, secret_scan, simhash_dedup
from foliant.llm.common import shared_dir, table

#: How far a text's likeliest language must be from a blind guess (0) toward certainty (1), however many languages are learned; texts without letters are rejected too.
LEAST_GAIN = 0.08


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    return language_id.keep(docs, LEAST_GAIN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id; one without a doc_id only where no other is."""
    return simhash_dedup.keep_one(docs, unnamed=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text of each document."""
    return bpe_codec.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("BPE encoding and decoding", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
