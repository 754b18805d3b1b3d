"""From raw documents to packed training sequences, as five stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import exact_dedup, mixing, ngram_join, packing, quality
from tamis.llm.common import dropped, scratch, stored


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by word 5-grams."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them: repeated, left out or cut so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token of each drawn document goes."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer stand in the way of SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written in the shared folder and read again, and what the stage wrote
    on its way, with the result of the stage before, is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = list(scratch)
        result = stored(stage(spark, docs, sf_dir), f"stage-{k}")
        dropped(*[t for t in scratch if t is docs or (t is not result and not any(t is b for b in before))])
        docs = result
    return docs
