"""The corpus pipeline: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from personagraph.llm import curriculum, quality_votes, simhash_trie, spaced_seeds, token_columns
from personagraph.llm.catalog import vocabulary
from personagraph.llm.common import cut, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_votes.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies within two bits stays, as in op5; README tells how many near copies that finds."""
    return simhash_trie.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return spaced_seeds.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often as the mix takes them."""
    return curriculum.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream as token columns, and the digest of each row as read back."""
    path = scratch(spark)
    token_columns.write(token_columns.encoded(docs, vocabulary()), path)
    return token_columns.digests(token_columns.read(spark, path))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: The first stage estimates by iteration, which SQL cannot express; a test runs all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
