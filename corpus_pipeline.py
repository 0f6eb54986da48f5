"""A corpus pipeline: five stages over ``documents``, each written and read again.

1. toxicity: a model trained on the labelled rows rejects toxic documents.
2. n-gram Jaccard join: one document of each group of near duplicates stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. mixing: documents are taken so that sources come to their target weights.
5. sharding: every document gets a shard and its slot in it.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontam, jaccard, mixing, sharding, toxicity
from weft.llm.stages import stage, table

SHARDS = 16
TOXIC = 0.5  # documents that score this much go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is trained on all labelled rows that are still there."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(True))
    return toxicity.keep_below(docs, model, TOXIC)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that is taken several times is as many rows."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL expresses a string kernel or balanced sampling: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
