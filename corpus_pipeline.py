"""From raw documents to shuffled shards: STAGES in order, each over all that the one before kept.

A function takes (spark, docs, sf_dir) and returns a DataFrame. The stages share no state: each can
be written as Parquet and reread as the next one's `docs`. All but the last return the columns of
`docs`. Null and empty texts fail the quality rules; rows that repeat a doc_id are one document for
the near-duplicate stage; an empty table passes every stage as an empty table; columns that `docs`
has besides are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import mixing, near_copies, quality, sharding, simhash, tiling
from quotemill.llm.common import table

#: Nine tenths of the tokens, each document at most once.
PIPELINE_MIX = mixing.Mix(budget_percent=90, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the one with the smallest doc_id.

    Copies are found by op3's SimHash links, verified, and by MinHash bands between the groups that these leave apart.
    """
    return simhash.drop_near_duplicates(docs, near_copies.near_copies)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are chosen up to the token budgets of their domain, language and source."""
    return mixing.take_mix(docs, PIPELINE_MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard and the slot of each document."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SimHash components and string tiles can't be stated in SQL; tests/llm/plain.py states all stages row by row.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
