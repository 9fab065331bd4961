"""A corpus pipeline: each stage's rows are written as Parquet and read by the next.

All stages take nulls in any column, texts of any length, repeated rows, equal
ids, empty tables and more columns of any names; all but the last return the
columns that they are given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from discloom.llm import decontaminate, mixing, neardup, quality, sharding
from discloom.llm.support import fresh, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its text alone; null and empty texts count as texts
    without words.  Without any labelled row all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Groups are linked by texts, whatever the ids; the smallest id stays.  Of rows
    equal in id and text one stays; rows without words are in no group and stay.
    """
    return neardup.keep_one(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Each row is judged by its text alone; null and empty texts stay, and all do
    where the benchmark is empty.  Items too short for any edit count where they
    cut no word.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), whole_words=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture.

    A null source is a source of its own.  Rows without an id come first in their
    source, rows of one id next to each other; texts play no part.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and place in the mixture, each shard in its order; equal texts share a shard.

    Reading Parquet keeps no order, so the place is worked out again from the rows.
    Null texts are one group, as are empty ones; every row is kept.
    """
    # Shards first: what is worked out for them and for the places then moves no texts.
    sharded = sharding.shard_documents(docs)
    shard, place = sharded.columns[-1], fresh(sharded, "mix_place")
    return mixing.with_places(sharded, place).repartitionByRange(shard, place).sortWithinPartitions(shard, place)


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
