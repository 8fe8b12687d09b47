"""Statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postora.sources.tables import numbered


def term_frequency(postings: DataFrame) -> DataFrame:
    """field, term, n: occurrences of each term, in superseded versions as well."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("n"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """field, term, n: documents with each term."""
    return postings.groupBy("field", "term").agg(F.count_distinct("doc_id").alias("n"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """field, n: distinct terms of each field."""
    return postings.groupBy("field").agg(F.count_distinct("term").alias("n"))


def dictionary(postings: DataFrame) -> DataFrame:
    """field, term, term_id: distinct terms, numbered from 1 in the order of fields and of their UTF-8 bytes."""
    return numbered(postings.select("field", "term").distinct(), ["field", "term"], "term_id")


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def positions(postings: DataFrame) -> DataFrame:
    """field, term, doc_id, tf and the positions in order."""
    return postings.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def set_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of two sets of ids and of their intersection, union, differences and symmetric difference, in one pass."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return tagged.agg(total("l").alias("left_n"), total("r").alias("right_n"), total(F.col("l") * F.col("r")).alias("both"), F.count("*").alias("either"), total(F.col("l") * (1 - F.col("r"))).alias("left_only"), total(F.col("r") * (1 - F.col("l"))).alias("right_only"), total(F.abs(F.col("l") - F.col("r"))).alias("one_only"))


def cardinality(rows: DataFrame, key: str) -> DataFrame:
    """n, the number of distinct ids from 0 up, by bitmaps that add up across tasks."""
    each = rows.groupBy(F.bitmap_bucket_number(key).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("m"))
    return each.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("n"))
