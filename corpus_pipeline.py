"""A training corpus from ``documents``: clean, good, distinct, and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, exact_dedup, packing, quality, simhash, toxicity
from corpusloom.llm._common import staged

TOXIC, GOOD = 0.5, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC, in all their columns; null texts count as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(toxicity.scorer(docs, labels) < TOXIC)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of GOOD or more, in all their columns; null texts count as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(quality.scorer(docs, labels, threshold=GOOD) >= GOOD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, in all its columns."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, in all its columns."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, bpe.tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: SQL can't express the trained models and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
