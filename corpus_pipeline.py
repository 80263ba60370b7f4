"""Corpus pipeline: quality filter, near-duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the folder all executors
share and reads again as the next stage's documents. All stages but the last return the columns of documents:

* quality: rows that the classifier rejects go.
* near_duplicates: of each SimHash component one row with its smallest doc_id stays, also of repeated rows and rows without id.
* secrets: spans that the scan finds are replaced in the text.
* mix: each row stays as often as the source mix takes the whole document.
* tokens: adds the token ids; their decoded text is the text.

Null and empty texts, very long texts, ties, repeated rows, rows without id and empty tables have the results that the operators
define; the columns of documents, also unknown ones, pass through all stages.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe_stream, mixing, quality, secrets, simhash_dedup
from lodestack.llm.common import checkpoint_dir, delete, table, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_row_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_stream.encode(docs, vocabulary_path())


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("secrets", secrets_stage), ("mix", mix_stage), ("tokens", tokens_stage)]

#: A trained classifier and a learned scan have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its folder; the folders of the stages before are deleted as soon as the next one is written."""
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{os.urandom(8).hex()}", None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
