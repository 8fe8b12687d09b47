"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from postora import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    held = duckdb.connect()
    for f in os.listdir(DATA):
        held.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return held


def plain(value):
    return int(value) if isinstance(value, float) and value.is_integer() else value


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_matches_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    if name in catalogue.ORACLES:
        wanted = tables.sql(catalogue.ORACLES[name])
        order = [wanted.columns.index(c) for c in columns]
        assert len(order) == len(wanted.columns)
        assert rows == sorted(repr([plain(r[i]) for i in order]) for r in wanted.fetchall())
    else:
        assert rows


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rare_terms_are_read_from_postings(spark, tables):
    rare, common = (plan_of(catalogue.QUERIES[n](spark, DATA)) for n in ("rare_term", "common_term"))
    assert "Or(EqualTo(term,apache),EqualTo(term,license))" in rare and "f0_values" not in rare
    assert "array_contains(f0_values" in common and "term" not in common and "Exchange" not in common


def test_ranges_of_single_numbers_are_pushed_down_and_compiled(spark, tables):
    from postora.plans.ast import Range
    from postora.plans.compiler import by_predicate

    plan = plan_of(by_predicate(Range("n_chars", 500, 2000), catalogue._documents(spark, DATA)))
    assert "GreaterThanOrEqual(f3_number,500)" in plan and "f3_numbers" not in plan and "*(1) Filter" in plan


def test_default_plan_of_a_search_shuffles_nothing(spark, tables):
    plan = catalogue.QUERIES["nested_boolean"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "f0_values" in plan and "f0_positions" not in plan
