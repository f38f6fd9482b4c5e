"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.llm import decontaminate, html_wrappers, jaccard_join, line_runs, mixing, quality, secret_forest, sentence_spans, token_codes, warc
from queuemill.llm import differencing, hilbert_blocks, set_links, spelling_variants
from queuemill.llm.tables import ORACLES, QUERIES, query, table
from queuemill.session import stored


@query("op1_html_wrappers")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


@query("op2_secret_forest")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in documents that ``labels`` has serve as the reviewed ones; every document is scanned."""
    docs = table(spark, sf_dir, "documents")
    found = stored(secret_forest.findings(docs, secret_forest.dictionary(docs)), "secret-findings")
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    model = secret_forest.train(secret_forest.reviewed(found.join(ids, "doc_id", "left_semi")))
    judged = secret_forest.judge(found, model)
    digest = F.sha2("finding", 256).alias("finding_sha256")
    return judged.select("doc_id", "begin", F.length("finding").alias("length"), digest, "score", "is_secret")


@query("op3_benchmark_decontamination", decontaminate.SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("items")


@query("op4_sentence_spans")
def sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents"))


@query("op5_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op6_warc_salvage", warc.SQL)
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, model).drop("text")


@query("op8_line_dedup", line_runs.SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_runs.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_token_codes")
def token_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_jaccard_join")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = set_links.jaccard_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("class").alias("class_id"), "n_links")


@query("op11_spelling_variants", spelling_variants.SQL)
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.counted_words(table(spark, sf_dir, "documents"))
    return spelling_variants.spelling_variants(words, min_length=spelling_variants.MIN_LENGTH)


@query("op12_hilbert_negatives", hilbert_blocks.SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are disturbed and vectors scaled to whole numbers before mining, as the digest asks."""
    vectors = hilbert_blocks.whole_vectors(table(spark, sf_dir, "embeddings"))
    return hilbert_blocks.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op13_differencing_shards")
def differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.shard_report(table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]
