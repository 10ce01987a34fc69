"""A training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's docs.

Every stage works on all rows its predecessor kept. All but the last return the columns of documents; the last returns
the encoded documents (doc_id, n_tokens, ids_sha256, decoded_sha256).

run() gives the rows of the last stage. Language identification is a trained model, so no SQL gives the same rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from icuflow.llm import bpe, decontamination, jaccard, language_id, pii
from icuflow.llm.common import scratch_dir, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects (no text, no letter, or a score too low to trust) go."""
    return language_id.accepted_rows(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of five-word shingles alike by 0.8 or more) one row with the smallest doc_id stays; rows without an id or a word stay."""
    return jaccard.deduplicated_rows(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    return pii.redacted_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document and the text decoded from them, as digests."""
    return bpe.bpe_report(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard", deduplicated),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
