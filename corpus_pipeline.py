"""The corpus pipeline: quality, near-dedup, decontamination, mixing and token output, one table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logquarry.llm import decontamination, mixing, near_dedup, quality, token_output
from logquarry.llm.common import stage
from logquarry.llm.queries import tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five words, a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mix_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token sequences in training order."""
    return token_output.training_order(docs, tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup_filter),
    ("decontamination", decontamination_filter),
    ("mixing", mix),
    ("token_output", token_shards),
]

#: Trained models, sketches and tokenizers cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
