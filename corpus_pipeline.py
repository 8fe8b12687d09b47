"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes the documents that the stage before kept and returns the columns of documents; the last adds where
each document lies. Columns of any name pass through every stage, also those named like a column that an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postora.llm import decontaminate, minhash, mixing, quality, sharding
from postora.llm.frames import free, shared_folder

#: A document goes if the classifier holds it likelier than not to be bad.
LEAST_QUALITY = 0.5
SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject.

    Whole texts alone decide, so repeated rows fare alike; null and empty texts fare as the learned bias says, which
    holds them good where most labels are. Null keys have no labels and are judged like others. Without documents the
    result is empty; without labels everything stays.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col(free("quality_score", docs.columns)) >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least key.

    Whole texts are compared. Documents with a null key or without words stay; repeated rows fare alike, and rows of
    equal key with other texts are documents of their own. Without documents the result is empty.
    """
    return minhash.without_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Whole texts are searched. Null and empty texts hold none; null and empty items are held by none; repeated rows fare
    alike. Without documents the result is empty; without items everything stays.
    """
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(free("leak_found", docs.columns)) == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times, in training order.

    Whole texts count. A null source is a source; null and empty texts have size 0; equal rows are taken in any order
    among themselves, equal times come in any order. Without documents the result is empty.
    """
    taken = mixing.mix(docs)
    positions = taken.columns[-1]
    return mixing.in_training_order(taken.select(*docs.columns, positions), positions=positions).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard_size, shard_crc32, shard, shard_slot and shard_grown (after underscores where documents
    have such columns).

    A null key is a key; repeated rows share a shard and have slots of their own; null texts have size 1. Without
    documents the result is empty.
    """
    return sharding.assign(docs, sharding.Topology.even(SHARDS))


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("decontamination", without_leaks), ("mixing", mixed), ("sharding", sharded)]

#: A trained model and hashes of shingles are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. What a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
