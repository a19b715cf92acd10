"""From raw documents to token ids: toxic texts, copies and benchmark passages go, secrets are masked, the rest is encoded.

Each stage takes all rows that the one before it kept. Nulls in any column, empty and very long texts, repeated rows and empty tables
pass through as the operators' docstrings say: a row without text is neither toxic, a copy, contaminated nor secret, and has no
tokens. Extra columns stay up to the last stage, which returns doc_id and the digests of its tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paywarden.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from paywarden.llm.queries import VOCABULARY, table
from paywarden.llm.shared import small_batches, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.without_secrets(docs, secret_scan.learn(secret_scan.known(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_copies), ("decontamination", drop_benchmark), ("secret_scan", mask_secrets), ("bpe", encode)]

#: Training, inferred automata and BPE can't be said in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
