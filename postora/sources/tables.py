"""Tables that the engine writes for itself."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name where all executors can write: under spark.checkpoint.dir. Only where driver and executors are
    one process may a local one stand in, with a warning; elsewhere an unset folder raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="postora-")
            warnings.warn(f"spark.checkpoint.dir is unset; tables are stored in {folder}", stacklevel=2)
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def files_under(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Files under a folder and their bytes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    return found.getFileCount(), found.getLength()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, folder: str | None = None, *partition_by: str) -> DataFrame:
    folder = folder or scratch(df.sparkSession)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, order: list[str], out: str = "doc_id", start: int = 1) -> DataFrame:
    """df with consecutive numbers in the given order. Rows are range-partitioned and sorted, stored with their place
    in the partition, and the counts of partitions are summed: no partition holds all rows. Rows of equal order come in
    that of a hash, so that they may lie in several ranges."""
    ties = F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    sorted_ = df.repartitionByRange(*order, ties).sortWithinPartitions(*order, ties).withColumn("_place", F.monotonically_increasing_id())
    kept = stored(sorted_)
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    if not before:
        return kept.withColumn(out, F.lit(start).cast("long")).drop("_place")
    offsets = df.sparkSession.createDataFrame(before, "p int, before long")
    return kept.join(F.broadcast(offsets), part == F.col("p")).withColumn(out, (F.col("before") + place + start).cast("long")).drop("_place", "p", "before")
