"""Requests and their answers."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postora.operators.scoring import Scorer, attributes, best_first, constant, with_defaults
from postora.operators.snapshot import live
from postora.plans.ast import normalised
from postora.plans.compiler import STRATEGIES, predicate
from postora.plans.parser import parse
from postora.sources.ingest import Index


#: Slices of the versions that a search with a time limit looks through one by one.
SLICES = 16


@dataclass(frozen=True)
class SearchRequest:
    """What is asked. sort_field, sort_reverse and stime are accepted and change nothing. Where `enforce_time` is set, the
    search looks through the versions in slices, newest first, begins none once qtime milliseconds have passed, and
    answers with what it has found; by default results are exact and qtime changes nothing either."""

    query: str
    offset: int = 0
    limit: int = 10
    sort_field: str = "default"
    sort_reverse: bool = False
    sort_map: Mapping[str, int] | None = None
    fields: Sequence[str] | None = None
    qtime: int = 20
    stime: int = 10
    enforce_time: bool = False

    def __post_init__(self) -> None:
        if self.offset < 0 or self.limit < 0:
            raise ValueError("offset and limit must not be negative")


@dataclass(frozen=True)
class SearchResponse:
    """docs: rows of this page; hits: all matches; results: score, doc_id, uid and fields of the page, in order;
    time: milliseconds; phases: milliseconds of each; complete: whether all versions were looked through."""

    docs: int
    hits: int
    results: DataFrame
    time: int
    phases: dict[str, float] = field(default_factory=dict)
    complete: bool = True


@dataclass(frozen=True)
class ResultCode:
    """0 where an update went well, else 1 and why."""

    code: int
    msg: str = "ok"


def matches(index: Index, request: SearchRequest, at: int | None = None, scorer: Scorer = constant, strategy: str = "predicate") -> DataFrame:
    """doc_id, uid and score of all matches, unordered. The scorer may use columns of `index.docs` and, where fields are
    stored, the sort attributes."""
    tree = parse(request.query, request.qtime).root
    if strategy == "predicate":
        found = live(index.docs, at).where(predicate(normalised(tree), index.fields))
    else:
        found = index.docs.join(STRATEGIES[strategy](tree, index, at), "doc_id", "left_semi")
    if scorer is not constant and index.stored is not None:
        found = found.join(attributes(index.stored), "uid", "left")
    return found.select("doc_id", "uid", scorer(with_defaults(request.sort_map)).alias("score"))


def page(found: DataFrame, request: SearchRequest) -> DataFrame:
    """The page of the matches, best first: offset past the last gives none, a short last page what there is."""
    return found.orderBy(*best_first()).offset(request.offset).limit(request.limit)


def projected(fields: Sequence[str] | None):
    """The stored fields that are asked for, of those that a document has."""
    if fields is None:
        return F.col("fields")
    wanted = list(fields)
    return F.map_filter("fields", lambda k, v: (k.isin(*wanted) if wanted else F.lit(False)) & v.isNotNull())


def with_stored(rows: DataFrame, stored: DataFrame | None, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows with their stored fields, null where nothing is stored under the uid."""
    if stored is None:
        return rows.withColumn("fields", F.lit(None).cast("map<string,string>"))
    return rows.join(stored.select("uid", projected(fields).alias("fields")), "uid", "left")


def _until(found: DataFrame, docs: DataFrame, request: SearchRequest, ends: float) -> tuple[int, list, bool]:
    """hits and the best rows of as many slices of doc_ids, newest first, as begin in time; and whether those are all.
    The first is always looked through."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    hits, best, needed = 0, [], replace(request, offset=0, limit=request.offset + request.limit)
    if low is None:
        return 0, [], True
    step = max(1, -(-(high - low + 1) // SLICES))
    for top in range(high, low - 1, -step):
        if top != high and time.perf_counter() > ends:
            return hits, best, False
        own = found.where(F.col("doc_id").between(top - step + 1, top)).cache()
        hits += own.count()
        best = sorted(best + page(own, needed).collect(), key=lambda r: (-r["score"], -r["doc_id"]))[: needed.limit]
        own.unpersist()
    return hits, best, True


def search(index: Index, request: SearchRequest, at: int | None = None, scorer: Scorer = constant, strategy: str = "predicate") -> SearchResponse:
    """One page and the number of matches, as of one snapshot; exact unless a time limit is enforced and met. Malformed
    queries raise ValueError."""
    began = time.perf_counter()
    found = matches(index, request, at, scorer, strategy)
    if request.enforce_time:
        hits, best, complete = _until(found, index.docs, request, began + request.qtime / 1000)
        searched = time.perf_counter()
        top = best[request.offset :]
    else:
        found = found.cache()
        hits, complete = found.count(), True
        searched = time.perf_counter()
        top = page(found, request).collect()  # a page, of `limit` rows at most
        found.unpersist()
    sorted_ = time.perf_counter()
    rows = index.docs.sparkSession.createDataFrame([(i, r["doc_id"], r["uid"], r["score"]) for i, r in enumerate(top)], "rank int, doc_id long, uid long, score double")
    results = with_stored(rows, index.stored, request.fields).select("rank", "doc_id", "uid", "score", "fields").orderBy("rank")
    ended = time.perf_counter()
    phases = {"search": (searched - began) * 1000, "sort": (sorted_ - searched) * 1000, "assemble": (ended - sorted_) * 1000}
    return SearchResponse(len(top), hits, results, round((ended - began) * 1000), phases, complete)
