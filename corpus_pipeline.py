"""Cleaning pipeline over ``documents``: the stages of the training-data operators, each written and read again.

Every stage judges rows by their own text: rows with a null or a repeated doc_id are judged like any others, null,
empty and very long texts have the results stated at each stage, an empty table stays empty, and further columns,
whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_ledger.llm.common import stored
from corpus_ledger.llm.decontamination import decontaminate
from corpus_ledger.llm.entropy_mixing import mix_documents
from corpus_ledger.llm.hilbert_sharding import shard_documents
from corpus_ledger.llm.minmax_dedup import deduplicate
from corpus_ledger.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labelled documents of the input tables. Null
    and empty texts have no terms and score as such; equal texts score alike."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the first as stored: five-word shingles, similarity 0.8.
    Texts without words are linked with nothing and stay."""
    return deduplicate(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go, or a shorter item as a whole; items without
    an id count too. Texts without words stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the sources meet their target words; a null source is one of
    its own, texts without words stay once, and each of several equal rows has its own number of copies."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; shard sizes differ by one row at most."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

# Toxicity scores are learned from labels and the shards follow from rates solved by iteration, which SQL
# cannot express; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
