"""From raw documents to a sharded training mix: classify, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes every
stage's result to the shared folder and reads it back, so a lost executor never repeats earlier stages.

All stages pass on every column of docs unchanged, whatever extra columns are called. Null and empty texts are texts without
words: judged as such, linked with nothing, never contaminated, not taken by the mix. Rows that repeat an id and rows without one
are handled as the operators' docstrings say. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquant.llm import decontam, jaccard, maglev, mixing, rules
from terraquant.session import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join; rows without words or without copies stay."""
    return jaccard.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, repeated ones twice; those without words are never taken."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and shard; documents without an id share one."""
    return maglev.assign_shards(docs)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The stages are not expressible in SQL; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each reading what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
