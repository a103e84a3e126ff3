"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Every stage takes what its predecessor kept.  The first four return rows of
``documents`` with its columns; the last writes the token files and returns what
they say of each document.

Nulls: a null text has no words, so the quality stage rejects it; a null id, source or lang is a
value of its own.  Empty texts go with the null ones; very long ones are handled whole.  Ties and repeated rows: rows equal in id and
text are near duplicates, one stays; equal ranks of the mix are settled by id.  Empty tables: no rows.
Extra columns of ``documents``, whatever their names, pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.decontamination import decontaminate
from weftgraph.llm.jaccard import one_of_each
from weftgraph.llm.mixing import mix_documents
from weftgraph.llm.quality import quality_filter
from weftgraph.llm.tokens import token_output

#: Pieces in the encoder's cache: fewer than alone, as the workers that keep it serve the other stages too.
CACHE_PIECES = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to bring their sources to the target weights."""
    return mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ascending id order, with Elias-Fano boundaries."""
    return token_output(docs, cache=CACHE_PIECES)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]
#: Tokenisation and min-wise hashing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    from weftgraph.plans.work import drop, table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, name)
        drop(given)
    return docs
