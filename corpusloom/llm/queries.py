"""The queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, hnsw, html_text, packing, quality, shards, simhash, suffix_lm, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.tokenizer_file("byte_bpe_50k.tiktoken"))


@query
def op7_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.tokenizer_file("byte_bpe_multi_50k.tiktoken"))


@query
def op4_toxicity_fm(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_suffix_tree_lm(spark, sf_dir):
    return suffix_lm.score(table(spark, sf_dir, "documents"), whole=True)


@query
def op10_line_crf_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_html_differencing(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_kd_tree_shards(spark, sf_dir):
    return shards.shard(table(spark, sf_dir, "documents"))


@query
def op5_hnsw_neighbours(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))
