"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the
next stage's docs. All but the last return the columns of documents. Rows that repeat an id and text leave
one; null texts are empty ones; empty tables give empty tables; other columns are carried along, whatever their names. Whole
texts pass through Arrow in batches that the session bounds in bytes (64 MiB unless set otherwise)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import byte_bpe, decontamination, exact_dedup, ngram_join, quality
from turnledger.llm.common import read, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a Jaccard similarity of 0.8 or more one stays."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage of ten words go."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what stays."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: SQL cannot train the classifier; tests/llm/test_pipeline.py holds all stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
