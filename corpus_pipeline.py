"""From raw documents to shards: five stages over the operators of ``weirflow.llm``.

Quality rules, near duplicates, benchmark decontamination, mixing to target weights, and
sharding, in this order. Every stage takes what the one before kept and returns documents;
the last returns the place of each document in its shard.

A stage is written before the next one begins, so a lost executor costs what it was working on,
and what a stage has read is removed when the stage is written; the last stage's rows stay until
the checkpoint folder is cleared.

Defined results: null, empty and short texts go with the quality rules; rows that repeat id and
text are one document from the second stage on; null ids and sources are kept as they are; very
long texts pass whole through every stage; a document that the mix takes several times has as
many places; other columns, whatever their names, are kept up to the last stage; empty tables
give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import decontam, mixing, near_dup, quality, sharding
from weirflow.llm._common import checkpoint_path, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near-dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Near duplicates are found by hashing and alignment, which SQL does not express.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store holds it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_path(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{place}")
        docs = spark.read.parquet(f"{base}/{place}")
        if place:
            _remove(spark, f"{base}/{place - 1}")
    return docs
