"""From raw documents to shuffled, mixed and sharded training documents.

Each stage takes what the stage before kept and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decontaminate, mixing, quality, sharding, simhash
from fleetlens.llm.common import read, write_and_read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal SimHash fingerprints."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, shuffled."""
    return mixing.replicate(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, shard and slot."""
    return sharding.histogram_shards(docs)


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed),
          ("shard", sharded)]

#: The classifier and the fingerprints are not for SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
