"""Corpus pipeline: quality rules, quality classifier, near-dedup, decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns documents' own columns; the last returns the
encoded documents.  Each result is written as Parquet and read again as the
next stage's documents.

Defined results: null and empty texts, and those of fewer than ten words, go in
the first stage; rows with a null or repeated doc_id are rows like any other in
every stage; exact copies are near copies; of rows equal in id and text any one stays; empty
tables of documents, labels or benchmark give empty results, no threshold and
nothing to drop, in this order; other columns stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm import bpe, isolation, kneser_ney, lsh_forest, tiling
from driftline.llm.queries import OP2_QUANTILE, OP2_SLACK
from driftline.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that neither the base rules nor the isolation forest reject."""
    table = written(isolation.rule_table(docs), "rules")
    return isolation.keep_rows(docs, isolation.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose perplexity is within their language's threshold; texts without words go."""
    return kneser_ney.keep_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), OP2_QUANTILE, OP2_SLACK)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of least doc_id, nulls last; of rows that repeat this id, one.

    Rows are told apart by themselves, so that other texts with a repeated or missing doc_id stay.
    """
    return lsh_forest.keep_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of a benchmark item or more."""
    return tiling.keep_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the forest, the language model or the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
