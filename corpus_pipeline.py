"""From raw documents to token files: every stage works on what the one before it kept."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.llm import decontaminate, jaccard_join, mixing, quality, token_codes
from queuemill.llm.tables import table
from queuemill.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones."""
    model = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, model).filter("kept").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8, the one with the smallest id."""
    return jaccard_join.first_of_each(docs).select(COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: passages of documents, one row per turn."""
    return mixing.mix_documents(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of ids, and what they hold per row."""
    return token_codes.token_index(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmarks),
    ("source_mix", mixed),
    ("token_codes", tokens),
]

#: Trained weights, tokenizers and file formats are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(root, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
