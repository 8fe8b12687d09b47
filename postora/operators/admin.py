"""Maintenance of an index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postora.operators.snapshot import live
from postora.sources.ingest import Index, postings_of
from postora.sources.tables import numbered


def compact(index: Index) -> Index:
    """The index with newest versions only, renumbered from 1 in their order; searches find the same uids."""
    kept = live(index.docs).withColumnRenamed("doc_id", "old_id").drop("superseded_by")
    docs = numbered(kept, ["old_id"], "doc_id").withColumn("superseded_by", F.lit(None).cast("long"))
    docs = docs.select(*index.docs.columns)
    return replace(index, docs=docs, postings=postings_of(docs, index.fields))


def purge(index: Index) -> Index:
    none = F.lit(False)
    return replace(index, docs=index.docs.where(none), postings=index.postings.where(none), stored=None if index.stored is None else index.stored.where(none))


def status(index: Index) -> DataFrame:
    """One row: versions, live ones, uids and the newest doc_id."""
    return index.docs.agg(F.count("*").alias("versions"), F.coalesce(F.sum(F.col("superseded_by").isNull().cast("int")), F.lit(0)).alias("live"), F.count_distinct("uid").alias("uids"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("max_doc"))


def runtime_status(index: Index) -> dict[str, object]:
    """What Spark says of itself: version, parallelism, executors' memory and running jobs."""
    context = index.docs.sparkSession.sparkContext
    memory = context._jsc.sc().getExecutorMemoryStatus()
    return {"version": context.version, "parallelism": context.defaultParallelism, "executors": memory.size(), "active_jobs": len(context.statusTracker().getActiveJobsIds()), "application": context.applicationId}
