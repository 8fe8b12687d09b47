"""Versions as of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_live(at: int | None = None) -> Column:
    """Versions that were newest of their uid once doc_id `at` had come; without it, those that are newest now."""
    if at is None:
        return F.col("superseded_by").isNull()
    return (F.col("doc_id") <= at) & (F.col("superseded_by").isNull() | (F.col("superseded_by") > at))


def live(docs: DataFrame, at: int | None = None) -> DataFrame:
    return docs.where(is_live(at))


def watermark(docs: DataFrame) -> DataFrame:
    """max_doc, the newest snapshot."""
    return docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("max_doc"))


def has_changes(docs: DataFrame, at: int) -> DataFrame:
    """uids that came, or came again, after the snapshot."""
    return docs.where(F.col("doc_id") > at).select("uid").distinct()
