"""A training corpus from raw documents: language, near duplicates, benchmark leaks, mix, token ids.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it wrote, and returns a frame. All but the last return the
columns of documents. Any column may be null, texts may be empty, rows may repeat, and the table may have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierstone.llm import bagminhash, decontam, huffman, langid, mixing, queries
from tierstone.session import fresh_path, tune

ORACLE_SQL = None  # network, signatures and tokenizer are beyond SQL; tests/llm compares the stages with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network sees a language; null, empty and letterless texts go."""
    tune(spark)
    return langid.recognised(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id."""
    tune(spark)
    return bagminhash.keep_one_of_each(docs, bagminhash.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    tune(spark)
    return decontam.without_leaks(docs, decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum draws them: a row per draw, whole texts, sorted by training position."""
    tune(spark)
    return mixing.mixed_documents(docs, mixing.plan_mix(docs, queries.schedule, queries.SHARE, queries.MOST, whole=True))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and describe every row of docs from it."""
    tune(spark)
    return huffman.encode_documents(docs, queries.tokenizer_path(), queries.END_ID)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(tune(spark), f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
