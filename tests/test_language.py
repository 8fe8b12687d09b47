from __future__ import annotations

import pytest

from postora.plans.ast import And, Difference, MatchAll, Or, Phrase, Range, Term, normalised
from postora.plans.parser import loads, parse

A, B = Term("f", "a"), Term("f", "b")


def test_single_quotes_and_bare_words():
    tree = parse("{'type':'AndQuery','queryNodes':[{'type':'TermQuery','field':'content','term':'装'},{type:TermQuery,field:f,term:12}]}", 300)
    assert tree.root == And((Term("content", "装"), Term("f", "12")))
    assert tree.root.nodes[0].millis == 300
    assert loads("{'a':'it\\'s \\u0041', 'b':[1,-2.5,true,null]}") == {"a": "it's A", "b": [1, -2.5, True, None]}


@pytest.mark.parametrize("kind", ["orquery", "OrQuery", " ORQUERY "])
def test_some_types_in_any_case(kind):
    assert parse(f'{{"type": "{kind}", "queryNodes": []}}').root == Or(())


@pytest.mark.parametrize(
    "text",
    ['{"type": "termquery", "field": "f", "term": "a"}', '{"type": "andquery", "queryNodes": []}', '{"type": "AndQuery", "queryNodes": []}', '{"type": "Nothing"}', '{"type": "TermQuery", "field": "f"}', '{"type": "RangeQuery", "field": "f", "start": 1, "end": 3000000000}', "{'type':", "[]", "{} x"],
)
def test_malformed_queries_raise(text):
    with pytest.raises(ValueError):
        parse(text)


def test_range_takes_numeric_strings():
    assert parse("{'type':'rangequery','field':'status','start':'1','end':2}").root == Range("status", 1, 2)


def test_phrases_check_their_arguments():
    for bad in ((None, ("a",), (0,)), ("f", (), ()), ("f", ("a", "b"), (0,)), ("f", (None,), (0,))):
        with pytest.raises(ValueError):
            Phrase(*bad)


def test_positive_terms_leave_out_what_is_taken_away():
    assert Or((And((A, B)), Difference(Term("f", "c"), Term("f", "d")))).positive_terms() == {A, B, Term("f", "c")}
    assert MatchAll().positive_terms() == frozenset()
    assert Phrase("f", ("a", "b"), (0, 1)).positive_terms() == {A, B}


def test_rendering_and_duplicates():
    assert str(And((A, B))) == "( field: f; term: a )  AND ( field: f; term: b ) "
    assert str(Difference(A, MatchAll())) == "( field: f; term: a ) - ( <MatchAllQuery> )"
    tree = Or((A, Difference(B, A)))
    assert tree.duplicate() == tree and hash(tree.duplicate()) == hash(tree)


def test_normalised_trees():
    assert normalised(And((A, And((B, A))))) == And((A, B))
    assert normalised(Difference(A, A)) == Or(())
    assert normalised(And((A, Or(())))) == Or(())
    assert normalised(Or((A, MatchAll()))) == MatchAll()
    assert normalised(And((MatchAll(), A))) == A
    assert normalised(Range("f", 3, 2)) == Or(())
