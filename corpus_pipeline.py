"""A pipeline for training text: quality, exact copies, near copies, source weights, tokens.

Every stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the docs of the next.
All stages but the last return the columns of ``documents``; the mix repeats a row as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltrail.llm import bpe, exact_dedup, jaccard, mixing, quality
from voltrail.llm.common import store, table, tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; ``docs`` is a read of Parquet files, as the contract of stages says."""
    return jaccard.drop_near_copies(docs, in_files=True)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row."""
    return bpe.digest(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("quality", good), ("exact copies", distinct), ("near copies", dissimilar), ("mix", weighted), ("tokens", tokens)]

#: The classifier, the shingle join and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
