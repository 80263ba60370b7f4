"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, hamming_search, html_text, mixing, ngram, quality, secrets, simhash_dedup, simhash_index, token_count
from .common import table, vocabulary_path


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.top_k(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scores(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.edits_and_neighbours(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_html_text, op2_source_mix, op3_secret_scan, op4_bpe_codec, op5_hamming_topk, op6_quality_classifier, op7_simhash_dedup, op8_token_counts, op9_ngram_scores, op10_fingerprints)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.ORACLE, "op5_hamming_topk": hamming_search.ORACLE}
