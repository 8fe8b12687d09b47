"""Scores of matches and their order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postora.plans.ast import Term
from postora.sources.ingest import Index

#: From the weights of a request to a score. The formula behind the weights isn't public, so the default is none.
Scorer = Callable[[Mapping[str, int]], Column]
# What a score is made of, by name.
ATTRIBUTES = ("created", "cfav", "zfavctu", "zeditor")
WEIGHTS = ("timeWeight", "favWeight", "editorWeight", "maxFav", "maxEditor")


def constant(weights: Mapping[str, int]) -> Column:
    return F.lit(0.0)


def with_defaults(weights: Mapping[str, int] | None) -> dict[str, int]:
    """All weights of a request, those not sent as 0."""
    return {w: int((weights or {}).get(w, 0)) for w in WEIGHTS}


def attributes(stored: DataFrame) -> DataFrame:
    """uid and its sort attributes as numbers, from stored fields; what is missing or no integer is 0."""
    number = lambda a: F.coalesce(F.when(F.col("fields")[a].rlike("^-?[0-9]+$"), F.col("fields")[a].try_cast("long")), F.lit(0))
    return stored.select("uid", *[number(a).alias(a) for a in ATTRIBUTES])


def newest_first() -> list[Column]:
    return [F.desc("doc_id")]


def best_first() -> list[Column]:
    """Greater scores first, of equal ones the newer document: a total order."""
    return [F.desc("score"), F.desc("doc_id")]


def term_relevance(term: Term, index: Index) -> DataFrame:
    """doc_id, tf and score, the root of tf, of documents with the term."""
    own = index.postings.where((F.col("field") == term.field) & (F.col("term") == term.term))
    return own.groupBy("doc_id").agg(F.count("*").alias("tf")).withColumn("score", F.sqrt("tf"))


def phrase_relevance(terms: list[Term], index: Index) -> DataFrame:
    """doc_id and score, 1 and the sum of the roots of the terms' tf, of documents with all terms."""
    names = [t.term for t in dict.fromkeys(terms)]
    own = index.postings.where((F.col("field") == terms[0].field) & F.col("term").isin(*names))
    counts = own.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("doc_id").agg(F.sum(F.sqrt("tf")).alias("s"), F.count("*").alias("n"))
    return counts.where(F.col("n") == len(names)).select("doc_id", (F.col("s") + 1).alias("score"))
