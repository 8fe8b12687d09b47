from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postora import schema
from postora.operators import admin, search, snapshot, statistics
from postora.operators.scoring import with_defaults
from postora.plans.ast import And, Difference, MatchAll, Or, Phrase, Range, Term
from postora.plans.compiler import STRATEGIES, count_matches
from postora.sources.ingest import from_documents


def sent(uid, stored=None, **fields):
    return (uid, [(n, str(len(t)), True, [(v, p, None) for v, p in t], None) for n, t in fields.items()], None, None, None, None if stored is None else (uid, stored))


def words(*texts):
    return [(t, i) for i, t in enumerate(texts)]


DOCS = [
    sent(1, {"title": "one", "created": "5", "none": None}, content=words("a", "b", "c"), status=[("1", None)]),
    sent(2, {"title": "two"}, content=words("b", "a", "c"), status=[("2", None)]),
    sent(3, content=words("c", "c", "a", "b"), status=[("2147483648", None), ("x", None)]),
    sent(1, {"title": "one again", "created": "7"}, content=words("d", "b"), status=[("2", None), ("-3", None)]),
    sent(4, content=[], other=words("a")),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(*d, i + 1) for i, d in enumerate(DOCS)]
    frame = spark.createDataFrame(rows, T.StructType([*schema.DOCUMENT.fields, T.StructField("doc_id", T.LongType())]))
    return from_documents(frame)


def ids(node, index, strategy="predicate", at=None):
    return sorted(r[0] for r in STRATEGIES[strategy](node, index, at).collect())


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_leaves_and_combinations(index, strategy):
    a, b, c = (Term("content", x) for x in "abc")
    get = lambda n: ids(n, index, strategy)
    assert get(a) == [2, 3] and get(b) == [2, 3, 4] and get(Term("content", "A")) == []
    assert get(And((a, b))) == [2, 3] and get(Or((Term("other", "a"), Term("content", "d")))) == [4, 5]
    assert get(Difference(b, a)) == [4] and get(Difference(MatchAll(), c)) == [4, 5] and get(MatchAll()) == [2, 3, 4, 5]
    assert get(Range("status", 2, 2)) == [2, 4] and get(Range("status", -5, 1)) == [4] and get(Range("status", 1, 2147483647)) == [2, 4]
    assert get(Phrase("content", ("a", "b"), (0, 1))) == [3] and get(Phrase("content", ("b", "c"), (0, 2))) == [2]
    assert get(Term("nowhere", "a")) == [] and get(Range("nowhere", 1, 2)) == [] and get(Phrase("nowhere", ("a",), (0,))) == [] and get(Or(())) == []


def test_old_snapshots(index):
    assert ids(Term("content", "a"), index, at=3) == [1, 2, 3]
    assert ids(MatchAll(), index, at=2) == [1, 2]
    assert ids(Term("content", "a"), index, "frequency", at=3) == [1, 2, 3]
    assert [r[0] for r in snapshot.has_changes(index.docs, 3).orderBy("uid").collect()] == [1, 4]


def test_strategies_agree_on_random_trees(index):
    drawn = random.Random(5)

    def tree(depth):
        kind = drawn.randrange(7 if depth else 4)
        if kind == 0:
            return Range("status", *sorted(drawn.choices(range(-4, 4), k=2)))
        if kind == 1:
            return MatchAll()
        if kind < 4:
            return Term(drawn.choice(["content", "other", "nowhere"]), drawn.choice("abcd"))
        if kind == 4:
            return Difference(tree(depth - 1), tree(depth - 1))
        return (And if kind == 5 else Or)(tuple(tree(depth - 1) for _ in range(drawn.randint(1, 3))))

    for _ in range(6):
        node = tree(3)
        assert ids(node, index) == ids(node, index, "sets") == ids(node, index, "flags"), str(node)


def test_answers(spark, index):
    request = search.SearchRequest(json.dumps({"type": "MatchAllQuery"}), offset=1, limit=2, fields=["title", "none"])
    answer = search.search(index, request)
    assert (answer.hits, answer.docs) == (4, 2)
    assert [(r["doc_id"], r["uid"], r["fields"]) for r in answer.results.collect()] == [(4, 1, {"title": "one again"}), (3, 3, None)]
    assert search.search(index, search.SearchRequest("{'type':'MatchAllQuery'}", offset=9)).docs == 0
    assert search.search(index, search.SearchRequest("{'type':'MatchAllQuery'}", limit=0)).hits == 4
    scored = search.search(index, search.SearchRequest("{'type':'MatchAllQuery'}", limit=1, sort_map={"timeWeight": 2}), scorer=lambda w: F.coalesce("created", F.lit(0)) * float(w["timeWeight"]))
    assert [(r["uid"], r["score"]) for r in scored.results.collect()] == [(1, 14.0)]
    assert set(with_defaults(None).values()) == {0}
    with pytest.raises(ValueError):
        search.search(index, search.SearchRequest("{'type':'Nothing'}"))
    with pytest.raises(ValueError):
        search.SearchRequest("", offset=-1)


def test_partial_answers_in_time(index):
    whole = search.search(index, search.SearchRequest("{'type':'MatchAllQuery'}", limit=3))
    timed = search.SearchRequest("{'type':'MatchAllQuery'}", limit=3, qtime=600000, enforce_time=True)
    answer = search.search(index, timed)
    assert answer.complete and (answer.hits, answer.docs) == (whole.hits, whole.docs)
    assert [r["doc_id"] for r in answer.results.collect()] == [r["doc_id"] for r in whole.results.collect()]
    late = search.search(index, search.SearchRequest("{'type':'MatchAllQuery'}", qtime=0, enforce_time=True))
    assert not late.complete and [r["doc_id"] for r in late.results.collect()] == [5] and late.hits == 1


def test_strategy_by_frequency(index, monkeypatch):
    from postora.plans import compiler

    few = Term("content", "d")
    assert compiler.is_rare(few, index) and not compiler.is_rare(MatchAll(), index)
    monkeypatch.setattr(compiler, "ALWAYS_FEW", 1)
    assert not compiler.is_rare(Term("content", "b"), index)
    for node in (few, Term("content", "b"), Phrase("content", ("a", "b"), (0, 1)), Or(())):
        assert ids(node, index, "frequency") == ids(node, index)


def test_pages_join_to_the_whole(index):
    whole = [r["doc_id"] for r in search.page(search.matches(index, search.SearchRequest("{'type':'MatchAllQuery'}")), search.SearchRequest("", 0, 100)).collect()]
    parts = [r["doc_id"] for o in range(0, 6, 2) for r in search.page(search.matches(index, search.SearchRequest("{'type':'MatchAllQuery'}")), search.SearchRequest("", o, 2)).collect()]
    assert whole == parts == [5, 4, 3, 2]


@pytest.mark.parametrize("n", [1, 2, 17])
def test_every_document_with_a_term_comes_back(spark, n):
    frame = spark.createDataFrame([sent(i, ddd=[("xxx", None)]) for i in range(1, n + 1)], DOCUMENT_ONLY)
    index = from_documents(frame)
    found = search.matches(index, search.SearchRequest("{'type':'TermQuery','field':'ddd','term':'xxx'}"))
    assert sorted(r["uid"] for r in found.collect()) == list(range(1, n + 1))
    assert {r["position"] for r in index.postings.collect()} == {255}


DOCUMENT_ONLY = "object_id int, fields array<struct<name:string,tokenCount:string,indexable:boolean,tokens:array<struct<value:string,position:int,weight:int>>,payload:int>>, timestamp int, segmentationHost string, shardIdx int, doc struct<uid:bigint,fields:map<string,string>>"


def test_compaction_changes_no_answer(index):
    after = admin.compact(index)
    for node in (Term("content", "b"), MatchAll(), Range("status", 1, 9)):
        uids = lambda i: sorted(r[0] for r in i.docs.join(STRATEGIES["predicate"](node, i, None), "doc_id", "left_semi").select("uid").collect())
        assert uids(index) == uids(after)
    assert sorted(r[0] for r in after.docs.select("doc_id").collect()) == [1, 2, 3, 4]
    assert admin.status(after).first().asDict() == {"versions": 4, "live": 4, "uids": 4, "max_doc": 4}
    assert admin.status(admin.purge(index)).first()["versions"] == 0
    assert admin.runtime_status(index)["executors"] >= 1


def test_counts(index):
    assert count_matches(Term("content", "b"), index).first()[0] == 3
    assert count_matches(Term("content", "b"), index, only=F.col("doc_id") > 3).first()[0] == 1
    tf = {(r["field"], r["term"]): r["n"] for r in statistics.term_frequency(index.postings).collect()}
    assert tf["content", "c"] == 4 and statistics.cardinality(index.docs, "doc_id").first()[0] == 5


def test_empty_index(spark):
    index = from_documents(spark.createDataFrame([], DOCUMENT_ONLY))
    assert STRATEGIES["predicate"](MatchAll(), index, None).count() == 0
    assert search.search(index, search.SearchRequest("{'type':'MatchAllQuery'}")).hits == 0
