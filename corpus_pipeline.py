"""A corpus pipeline of five stages over ``documents``; each stage is one operator of ``fabula.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fabula.llm import exact_dedup, jaccard_join, mixing, packing, quality
from fabula.llm._shared import materialize
from fabula.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learnt from the labelled documents of ``labels``: rejected documents go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts equal after lower-casing A-Z, the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: five words, similarity 0.8; the least doc_id of each component stays."""
    return jaccard_join.one_per_component(docs, k=5, threshold="0.8")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Systematic sampling to the targets of op6; a document drawn twice is there twice."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing into sequences of 2048 ids, one row per piece; ``copy`` tells repeats apart."""
    return packing.pack(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Near-duplicate components, encoding and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
