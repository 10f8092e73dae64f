"""From raw documents to training shards: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of `documents`.  SQL can't express the first stage (a trained classifier chain), so
there is no ORACLE_SQL; tests/llm run the stages on a small table and hold what each of them keeps,
takes or deals out against a plain version.

Defined results: a null or empty text is scored as one without words, is a near copy of nothing, is
never contaminated and has no size; rows with a null doc_id are no one's copies and stay; of equal
doc_ids all rows of the smallest one in a group stay; extra columns are handed on, but `shard` is the last stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate, ngram_join, slot_shards, source_mix, toxicity
from glyphmill.llm.common import durable, table

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; those that stand exactly at the threshold do too."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Four fifths of the shingles of five words make a near copy."""
    return ngram_join.one_of_each(docs, ngram_join.NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source is near its target; equal rows are taken alike."""
    return source_mix.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, by stored slots of nearly equal bytes."""
    return slot_shards.assign(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
