"""The search engine's registered queries over the driver's tables, and their SQL.

Indexes are built once for an application and a folder, and stored; queries read what is stored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postora.functions import bitsets, scalars
from postora.operators import admin, helpers, scoring, search, snapshot, statistics
from postora.plans import ast, compiler
from postora.plans.parser import parse
from postora.sources import ingest, store
from postora.sources.tables import scratch, stored
from postora.streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BUILT: dict[tuple, object] = {}


def _query(sql: str | None = None, name: str | None = None):
    def added(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return added


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], object]):
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    names = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    # a folder whose tables were written again is another folder
    key = (spark.sparkContext.applicationId, sf_dir, what, tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in names)))
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _documents(spark: SparkSession, sf_dir: str) -> ingest.Index:
    def build() -> ingest.Index:
        index = ingest.from_table(_table(spark, sf_dir, "documents"), "doc_id", "doc_id", ["text"], ["lang", "source", "n_chars"])
        docs = stored(index.docs)
        return replace(index, docs=docs, postings=ingest.postings_of(docs, index.fields))

    return _once(spark, sf_dir, "documents", build)


def _postings(spark: SparkSession, sf_dir: str) -> ingest.Index:
    """The documents' index with stored postings of the text."""

    def build() -> ingest.Index:
        index = _documents(spark, sf_dir)
        text = ingest.postings_of(index.docs, {"text": index.fields["text"]})
        return replace(index, postings=ingest.Index(index.docs, index.fields, text).kept().postings)

    return _once(spark, sf_dir, "postings", build)


def _parts(spark: SparkSession, sf_dir: str) -> ingest.Index:
    return ingest.from_table(_table(spark, sf_dir, "part"), "p_partkey", "p_partkey", [], ["p_brand", "p_name", "p_size", "p_type"])


def _events(spark: SparkSession, sf_dir: str) -> ingest.Index:
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return ingest.from_table(events, "user_id", "event_id", [], ["event_type", "k"])


def _t(field: str, term: object) -> dict:
    return {"type": "TermQuery", "field": field, "term": term}


def _and(*nodes: dict) -> dict:
    return {"type": "AndQuery", "queryNodes": list(nodes)}


def _or(*nodes: dict) -> dict:
    return {"type": "OrQuery", "queryNodes": list(nodes)}


def _minus(left: dict, right: dict) -> dict:
    return {"type": "DifferenceQuery", "leftNode": left, "rightNode": right}


def _range(field: str, start: object, end: object) -> dict:
    return {"type": "RangeQuery", "field": field, "start": start, "end": end}


def _matching(name: str, index, tree: dict, sql: str, out: str = "doc_id", strategy: str = "predicate") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compiler.STRATEGIES[strategy](parse(json.dumps(tree)).root, index(spark, sf_dir)).select(F.col("doc_id").alias(out))

    _query(sql, name)(run)


_D = "d AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tokens FROM documents)"
_P = "p AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS term, unnest(range(len(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')))) AS position FROM documents), o AS (SELECT * FROM p WHERE term <> '')"
_has = lambda t: f"list_contains(tokens, '{t}')"
_docs_where = lambda where: f"WITH {_D} SELECT doc_id FROM d WHERE {where}"


# Leaves

@_query(f"WITH {_D} SELECT doc_id, doc_id AS uid, 0.0::DOUBLE AS score, lang, source FROM d WHERE {_has('the')} ORDER BY doc_id DESC LIMIT 100")
def term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred documents with a term, and their stored fields."""
    request = search.SearchRequest("{'type':'TermQuery','field':'text','term':'the'}", limit=100)
    top = search.page(search.matches(_documents(spark, sf_dir), request), request)
    kept = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "lang", "source")
    return top.join(kept, "uid", "left").select("doc_id", "uid", "score", "lang", "source")


_matching("term_matches", _documents, _t("text", "the"), _docs_where(_has("the")))
_matching("term_unknown_field", _documents, _t("nowhere", "the"), "SELECT doc_id FROM documents WHERE false")
_matching("term_unknown_term", _documents, _t("text", "zzzzqqqq"), "SELECT doc_id FROM documents WHERE false")
_matching("exact_case_sensitive", _parts, _or(_t("p_brand", "Brand#11"), _t("p_brand", "brand#12")), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_brand = 'brand#12'", "p_partkey")
_matching("range_query", _documents, _range("n_chars", 500, "2000"), "SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 2000")
_matching("range_point", _parts, _range("p_size", 7, 7), "SELECT p_partkey FROM part WHERE p_size = 7", "p_partkey")
_matching("match_all", _documents, {"type": "MatchAllQuery"}, "SELECT doc_id FROM documents")
_matching("match_all_minus_term", _documents, _minus({"type": "MatchAllQuery"}, _t("text", "the")), _docs_where(f"NOT {_has('the')}"))
_matching("phrase_query", _documents, {"type": "SimplePhraseQuery", "field": "text", "terms": ["of", "the"], "positions": [0, 1]}, f"WITH {_P} SELECT DISTINCT x.doc_id FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.position = x.position + 1 WHERE x.term = 'of' AND y.term = 'the'")
_matching("phrase_with_gap", _postings, {"type": "SimplePhraseQuery", "field": "text", "terms": ["the", "the"], "positions": [0, 2]}, f"WITH {_P} SELECT DISTINCT x.doc_id FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.position = x.position + 2 WHERE x.term = 'the' AND y.term = 'the'", strategy="flags")


@_query("SELECT 0::BIGINT AS unknown_field, 0::BIGINT AS unknown_term")
def unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"unknown_field": (ast.Term("nowhere", "the"), None), "unknown_term": (ast.Term("text", "zzzzqqqq"), None)}
    return compiler.counted(_documents(spark, sf_dir), wanted)


@_query("SELECT count(*) FILTER (p_size BETWEEN 1 AND 25) AS whole, count(*) FILTER (p_size BETWEEN 1 AND 10 OR p_size BETWEEN 11 AND 25) AS parts FROM part")
def range_union_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ast.Or((ast.Range("p_size", 1, 10), ast.Range("p_size", 11, 25)))
    return compiler.counted(_parts(spark, sf_dir), {"whole": (ast.Range("p_size", 1, 25), None), "parts": (parts, None)})


@_query("WITH m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR || '.5' WHEN 2 THEN ' ' || p_size::VARCHAR ELSE p_name END AS mixed FROM part) SELECT p_partkey FROM m WHERE regexp_full_match(mixed, '-?[0-9]+') AND mixed::INTEGER BETWEEN 1 AND 2147483647")
def range_non_numeric_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    mixed = F.when(key % 4 == 0, size).when(key % 4 == 1, F.concat(size, F.lit(".5"))).when(key % 4 == 2, F.concat(F.lit(" "), size)).otherwise(F.col("p_name"))
    index = ingest.from_table(_table(spark, sf_dir, "part").withColumn("mixed", mixed), "p_partkey", "p_partkey", [], ["mixed"])
    return compiler.by_predicate(ast.Range("mixed", 1, 2147483647), index).select(F.col("doc_id").alias("p_partkey"))


# Combinations

_matching("and_query", _documents, _and(_t("text", "the"), _t("text", "of")), _docs_where(f"{_has('the')} AND {_has('of')}"))
_matching("or_query", _documents, _or(_t("text", "the"), _t("text", "des")), _docs_where(f"{_has('the')} OR {_has('des')}"))
_matching("difference_query", _documents, _minus(_t("text", "the"), _t("text", "that")), _docs_where(f"{_has('the')} AND NOT {_has('that')}"))
_NESTED = _or(_minus(_and(_t("text", "the"), _t("text", "of")), _t("text", "en")), _t("text", "des"))
_NESTED_SQL = _docs_where(f"({_has('the')} AND {_has('of')} AND NOT {_has('en')}) OR {_has('des')}")
_matching("nested_boolean", _documents, _NESTED, _NESTED_SQL)
_matching("nested_boolean_sets", _postings, _NESTED, _NESTED_SQL, strategy="sets")
_matching("nested_boolean_flags", _postings, _NESTED, _NESTED_SQL, strategy="flags")
_matching("term_and_range", _parts, _and(_t("p_brand", "Brand#11"), _range("p_size", 5, 30)), "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size BETWEEN 5 AND 30", "p_partkey")
_matching("fields_mixed", _documents, _and(_or(_t("lang", "en"), _t("lang", "fr")), _minus(_range("n_chars", 1000, 9000), _t("source", "src0"))), "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 1000 AND 9000 AND source <> 'src0'")


@_query(f"WITH {_D} SELECT count(*) FILTER ({_has('the')}) AS n, count(*) FILTER ({_has('the')} AND doc_id % 3 = 0) AS n_third FROM d")
def count_with_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = ast.Term("text", "the")
    return compiler.counted(_documents(spark, sf_dir), {"n": (term, None), "n_third": (term, F.col("doc_id") % 3 == 0)})


@_query("SELECT * FROM (VALUES ('text', 'the'), ('text', 'of'), ('text', 'des')) AS v(field, term)")
def positive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = parse(json.dumps(_NESTED)).root.positive_terms()
    return spark.createDataFrame([(t.field, t.term) for t in sorted(terms, key=str)], "field string, term string")


@_query(f"WITH {_D} SELECT (SELECT max(doc_id) FROM d WHERE {_has('des')} AND doc_id <= 150) AS newest_before, (SELECT min(doc_id) FROM d WHERE {_has('des')} AND doc_id >= 50) AS oldest_after")
def posting_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.navigated(ast.Term("text", "des"), _documents(spark, sf_dir), 150, 50)


# Versions

_LATEST = "l AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS superseded_by FROM events)"


@_query(f"WITH {_LATEST} SELECT user_id, event_id, event_type FROM l WHERE superseded_by IS NULL")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _events(spark, sf_dir)
    return snapshot.live(index.docs).select(F.col("uid").alias("user_id"), F.col("doc_id").alias("event_id"), F.get(index.fields["event_type"].values, F.lit(0)).alias("event_type"))


@_query(f"WITH {_LATEST} SELECT event_id, superseded_by FROM l")
def superseded_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).docs.select(F.col("doc_id").alias("event_id"), "superseded_by")


@_query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id <= 499 GROUP BY user_id")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.live(_events(spark, sf_dir).docs, 499).select(F.col("uid").alias("user_id"), F.col("doc_id").alias("event_id"))


@_query("SELECT DISTINCT user_id FROM events WHERE event_id > 499")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.has_changes(_events(spark, sf_dir).docs, 499).select(F.col("uid").alias("user_id"))


_matching("term_on_live_only", _events, _t("event_type", "click"), f"WITH {_LATEST} SELECT event_id FROM l WHERE superseded_by IS NULL AND event_type = 'click'", "event_id")
_matching("range_on_live_only", _events, _range("k", 10, 60), f"WITH {_LATEST} SELECT event_id FROM l WHERE superseded_by IS NULL AND (json_extract_string(props, '$.k'))::INTEGER BETWEEN 10 AND 60", "event_id")


@_query(f"WITH {_LATEST}, c AS (SELECT user_id, event_type, row_number() OVER (ORDER BY event_id) AS doc_id FROM l WHERE superseded_by IS NULL) SELECT doc_id, user_id, event_type FROM c")
def compact_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = admin.compact(_events(spark, sf_dir))
    return index.docs.select("doc_id", F.col("uid").alias("user_id"), F.get(index.fields["event_type"].values, F.lit(0)).alias("event_type"))


@_query(f"WITH {_LATEST}, c AS (SELECT event_type, row_number() OVER (ORDER BY event_id) AS doc_id FROM l WHERE superseded_by IS NULL) SELECT event_type AS term, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM c GROUP BY event_type")
def compact_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after compaction, under the new numbers."""
    postings = admin.compact(_events(spark, sf_dir)).postings.where("field = 'event_type'")
    return postings.groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@_query(f"WITH {_LATEST}, c AS (SELECT props, row_number() OVER (ORDER BY event_id) AS doc_id FROM l WHERE superseded_by IS NULL) SELECT doc_id FROM c WHERE (json_extract_string(props, '$.k'))::INTEGER BETWEEN 10 AND 60")
def compact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range after compaction, under the new numbers."""
    return compiler.by_predicate(ast.Range("k", 10, 60), admin.compact(_events(spark, sf_dir)))


@_query("SELECT true AS has_version, true AS has_executors, true AS has_parallelism")
def runtime_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = admin.runtime_status(_events(spark, sf_dir))
    return spark.createDataFrame([(bool(found["version"]), found["executors"] >= 1, found["parallelism"] >= 1)], "has_version boolean, has_executors boolean, has_parallelism boolean")


@_query(f"WITH {_LATEST} SELECT count(*) AS versions, count(*) FILTER (superseded_by IS NULL) AS live, count(DISTINCT user_id) AS uids, max(event_id) AS max_doc FROM l")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.status(_events(spark, sf_dir))


@_query("SELECT 0::BIGINT AS versions, 0::BIGINT AS live, 0::BIGINT AS uids, 0::BIGINT AS max_doc")
def purged_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.status(admin.purge(_events(spark, sf_dir)))


# Answers

def _paged(offset: int, limit: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = search.SearchRequest(json.dumps(_t("text", "the")), offset, limit)
        return search.page(search.matches(_documents(spark, sf_dir), request), request).select("doc_id")

    return run


_page_sql = lambda offset, limit: f"WITH {_D} SELECT doc_id FROM d WHERE {_has('the')} ORDER BY doc_id DESC LIMIT {limit} OFFSET {offset}"
_query(_page_sql(20, 10), "page_newest_first")(_paged(20, 10))
_query(_page_sql(100, 1000000), "page_tail")(_paged(100, 1000000))
_query(_page_sql(100000000, 10), "page_past_end")(_paged(100000000, 10))


@_query(f"WITH {_D} SELECT count(*) AS hits, least(count(*), 25) AS docs FROM d WHERE {_has('the')} AND {_has('of')}")
def hits_and_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.SearchRequest(json.dumps(_and(_t("text", "the"), _t("text", "of"))), limit=25)
    found = search.matches(_documents(spark, sf_dir), request)
    rest = F.greatest(F.count("*") - request.offset, F.lit(0))
    return found.agg(F.count("*").alias("hits"), F.least(rest, F.lit(request.limit)).alias("docs"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("uid"), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"), F.lit("none"), F.lit(None).cast("string")).alias("fields"))


@_query(f"WITH {_D}, t AS (SELECT doc_id FROM d WHERE {_has('the')} ORDER BY doc_id DESC LIMIT 50) SELECT t.doc_id, quality::VARCHAR AS quality, NULL::VARCHAR AS toxic, CASE WHEN l.doc_id IS NOT NULL THEN 1 END::INTEGER AS n_fields FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id")
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.SearchRequest(json.dumps(_t("text", "the")), limit=50, fields=["quality", "none", "nowhere"])
    top = search.page(search.matches(_documents(spark, sf_dir), request), request)
    found = search.with_stored(top, _labelled(spark, sf_dir), request.fields)
    return found.select("doc_id", F.col("fields")["quality"].alias("quality"), F.col("fields")["toxic"].alias("toxic"), F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"))


@_query(f"WITH {_D}, t AS (SELECT doc_id FROM d WHERE {_has('the')} ORDER BY doc_id DESC LIMIT 50) SELECT t.doc_id, l.doc_id IS NULL AS missing FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id")
def missing_stored_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.SearchRequest(json.dumps(_t("text", "the")), limit=50)
    top = search.page(search.matches(_documents(spark, sf_dir), request), request)
    return search.with_stored(top, _labelled(spark, sf_dir)).select("doc_id", F.col("fields").isNull().alias("missing"))


@_query("SELECT o_orderkey, 1000 * (o_orderkey % 97) + 10 * o_custkey AS score FROM orders WHERE o_orderstatus = 'O' ORDER BY score DESC, o_orderkey DESC LIMIT 40")
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    index = ingest.from_table(orders, "o_orderkey", "o_orderkey", [], ["o_orderstatus"])
    kept = orders.select(F.col("o_orderkey").alias("uid"), F.create_map(F.lit("created"), (F.col("o_orderkey") % 97).cast("string"), F.lit("cfav"), F.col("o_custkey").cast("string")).alias("fields"))
    request = search.SearchRequest(json.dumps(_t("o_orderstatus", "O")), limit=40, sort_map={"timeWeight": 1000, "favWeight": 10})
    by_weights = lambda w: F.col("created") * w["timeWeight"] + F.col("cfav") * w["favWeight"] + F.col("zeditor") * w["editorWeight"]
    found = search.page(search.matches(replace(index, stored=kept), request, scorer=by_weights), request)
    return found.select(F.col("doc_id").alias("o_orderkey"), "score")


@_query("SELECT p_partkey, p_size::DOUBLE AS score FROM part ORDER BY score DESC, p_partkey DESC LIMIT 30")
def score_ties_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _parts(spark, sf_dir)
    request = search.SearchRequest('{"type": "MatchAllQuery"}', limit=30)
    size = F.get(index.fields["p_size"].numbers, F.lit(0)).cast("double")
    return search.page(search.matches(index, request, scorer=lambda w: size), request).select(F.col("doc_id").alias("p_partkey"), "score")


@_query(f"WITH {_P} SELECT doc_id, count(*) AS tf, round(sqrt(count(*)), 9) AS score FROM o WHERE term = 'the' GROUP BY doc_id")
def term_relevance_sqrt_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.term_relevance(ast.Term("text", "the"), _postings(spark, sf_dir)).withColumn("score", F.round("score", 9))


@_query(f"WITH {_P}, m AS (SELECT DISTINCT x.doc_id FROM o x JOIN o y ON x.doc_id = y.doc_id AND y.position = x.position + 1 WHERE x.term = 'of' AND y.term = 'the'), t AS (SELECT doc_id, term, sqrt(count(*)) AS s FROM o WHERE term IN ('of', 'the') GROUP BY doc_id, term) SELECT doc_id, round(1 + sum(s), 6) AS score FROM t JOIN m USING (doc_id) GROUP BY doc_id")
def phrase_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase matches with 1 and the sum of the roots of their terms' frequencies."""
    index = _postings(spark, sf_dir)
    phrase = ast.Phrase("text", ("of", "the"), (0, 1))
    scores = scoring.phrase_relevance([ast.Term("text", t) for t in phrase.terms], index)
    found = compiler.phrase_matches(phrase, index.postings).select("doc_id").distinct()
    return scores.join(found, "doc_id", "left_semi").select("doc_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_D} SELECT row_number() OVER (ORDER BY doc_id DESC) - 6 AS rank, doc_id, doc_id AS uid, 0.0::DOUBLE AS score, (SELECT count(*) FROM d WHERE {_has('the')} AND NOT {_has('that')}) AS hits FROM d WHERE {_has('the')} AND NOT {_has('that')} ORDER BY doc_id DESC LIMIT 12 OFFSET 5")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search from request to answer. The sort field is accepted and changes nothing."""
    request = search.SearchRequest(json.dumps(_minus(_t("text", "the"), _t("text", "that"))), 5, 12, sort_field="n_chars", sort_reverse=True, stime=1)
    answer = search.search(_documents(spark, sf_dir), request)
    return answer.results.select(F.col("rank").cast("long").alias("rank"), "doc_id", "uid", "score", F.lit(answer.hits).cast("long").alias("hits"))


@_query(f"WITH {_D} SELECT true AS complete, count(*) AS hits, least(count(*), 10)::BIGINT AS docs FROM d WHERE {_has('of')}")
def search_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that looks through slices of the versions, in time for all."""
    answer = search.search(_documents(spark, sf_dir), search.SearchRequest(json.dumps(_t("text", "of")), qtime=3_600_000, enforce_time=True))
    return spark.createDataFrame([(answer.complete, answer.hits, answer.docs)], "complete boolean, hits long, docs long")


_matching("rare_term", _postings, _and(_t("text", "apache"), _t("text", "license")), _docs_where(f"{_has('apache')} AND {_has('license')}"), strategy="frequency")
_matching("common_term", _postings, _and(_t("text", "the"), _t("text", "of")), _docs_where(f"{_has('the')} AND {_has('of')}"), strategy="frequency")


# Statistics

@_query(f"WITH {_P} SELECT 'text' AS field, term, count(*) AS n FROM o GROUP BY term")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.term_frequency(_postings(spark, sf_dir).postings)


@_query(f"WITH {_P} SELECT 'text' AS field, term, count(DISTINCT doc_id) AS n FROM o GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.document_frequency(_postings(spark, sf_dir).postings)


@_query(f"WITH {_P} SELECT 'text' AS field, count(DISTINCT term) AS n FROM o")
def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.vocabulary(_postings(spark, sf_dir).postings)


@_query("SELECT max(doc_id) AS max_doc FROM documents")
def max_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.watermark(_documents(spark, sf_dir).docs)


@_query(f"WITH {_P} SELECT doc_id, count(*) AS tf, min(position)::INTEGER AS first_position, max(position)::INTEGER AS last_position FROM o WHERE term = 'of' GROUP BY doc_id")
def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.positions(_postings(spark, sf_dir).postings.where((F.col("field") == "text") & (F.col("term") == "of")))
    return found.select("doc_id", "tf", F.element_at("positions", 1).alias("first_position"), F.element_at("positions", -1).alias("last_position"))


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(_table(spark, sf_dir, "events"), "event_type")


_L, _R = _has("the"), _has("of")


@_query(f"WITH {_D} SELECT count(*) FILTER ({_L}) AS left_n, count(*) FILTER ({_R}) AS right_n, count(*) FILTER ({_L} AND {_R}) AS \"both\", count(*) FILTER ({_L} OR {_R}) AS either, count(*) FILTER ({_L} AND NOT {_R}) AS left_only, count(*) FILTER ({_R} AND NOT {_L}) AS right_only, count(*) FILTER ({_L} <> {_R}) AS one_only FROM d")
def bitset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _documents(spark, sf_dir)
    ids = lambda t: compiler.by_predicate(ast.Term("text", t), index)
    return statistics.set_counts(ids("the"), ids("of"), "doc_id")


@_query(f"WITH {_D} SELECT count(*) AS n FROM d WHERE {_has('the')}")
def bitmap_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cardinality(compiler.by_predicate(ast.Term("text", "the"), _documents(spark, sf_dir)), "doc_id")


# Key-value log

def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries: key user, value the event's type or, for every seventh, the mark of deletion; ten files."""
    events = _table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(store.TOMBSTONE.decode())).otherwise(F.col("event_type"))
    key, body, stamp = F.col("user_id").cast("string").cast("binary"), value.cast("binary"), (F.col("event_id") / 100).cast("int")
    return events.select(key.alias("key"), body.alias("value"), stamp.alias("tstamp"), (F.col("event_id") % 10).cast("int").alias("file_id"), F.col("event_id").alias("offset"), store.crc(key, body, stamp).alias("crc"))


_LOG = "e AS (SELECT user_id, event_id AS \"offset\", event_id // 100 AS tstamp, event_id % 10 AS file_id, CASE WHEN event_id % 7 = 0 THEN 'bitcask_tombstone' ELSE event_type END AS value FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tstamp DESC, file_id DESC, \"offset\" DESC) AS place FROM e)"
_shown = lambda df: df.select(F.decode("key", "UTF-8").cast("long").alias("user_id"), F.decode("value", "UTF-8").alias("value"))


@_query(f"WITH {_LOG} SELECT user_id, value FROM n WHERE place = 1")
def kv_newest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.newest(_log(spark, sf_dir)))


@_query(f"WITH {_LOG} SELECT user_id, value FROM n WHERE place = 1 AND value <> 'bitcask_tombstone'")
def kv_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.visible(store.checked(_log(spark, sf_dir))))


@_query(f"WITH {_LOG} SELECT user_id, value FROM n WHERE place = 1 AND value <> 'bitcask_tombstone' AND tstamp >= 100 - 3")
def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.visible(_log(spark, sf_dir), now=100, expiry_secs=3))


@_query(f"WITH {_LOG} SELECT user_id, value FROM n WHERE place = 1 AND value <> 'bitcask_tombstone' AND user_id IN (7, 23)")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.get(_log(spark, sf_dir), b"7", b"23"))


@_query(f"WITH {_LOG} SELECT value, count(*) AS n FROM n WHERE place = 1 AND value <> 'bitcask_tombstone' GROUP BY value")
def kv_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fold(_log(spark, sf_dir), F.count("*").alias("n"), by=[F.decode("value", "UTF-8").alias("value")])


@_query(f"WITH {_LOG} SELECT count(*) AS keys, max(tstamp)::INTEGER AS last FROM n WHERE place = 1")
def kv_fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fold_keys(_log(spark, sf_dir), F.count("*").alias("keys"), F.max("tstamp").alias("last"))


@_query(f"WITH {_LOG} SELECT file_id::INTEGER AS file_id, count(*) AS total, count(*) FILTER (place = 1) AS live, count(*) FILTER (place = 1) / count(*) AS ratio FROM n GROUP BY file_id")
def kv_live_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live_ratio(_log(spark, sf_dir))


@_query(f"WITH {_LOG}, r AS (SELECT file_id::INTEGER AS file_id, count(*) AS total, count(*) FILTER (place = 1) AS live FROM n GROUP BY file_id) SELECT *, CASE WHEN live = 0 THEN 'drop' WHEN total < 1000 THEN CASE WHEN (SELECT count(*) FROM r WHERE live > 0 AND total < 1000) >= 5 THEN 'compact' ELSE 'keep' END WHEN live / total < 0.4 THEN 'merge' ELSE 'keep' END AS action FROM r")
def kv_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_plan(_log(spark, sf_dir))


@_query(f"WITH {_LOG} SELECT user_id, value FROM n WHERE place = 1 AND value <> 'bitcask_tombstone'")
def kv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.newest(store.merged(_log(spark, sf_dir))))


@_query(f"WITH {_LOG} SELECT user_id, value FROM n WHERE place = 1 AND value <> 'bitcask_tombstone'")
def kv_merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored log, merged file by file."""
    log = f"{scratch(spark)}/log"
    store.put(log, _log(spark, sf_dir))
    store.merge_files(spark, log)
    return _shown(store.visible(store.checked(spark.read.parquet(log))))


@_query("SELECT conv_id, arg_max(text, turn) AS text, count(*) AS versions FROM conversations GROUP BY conv_id")
def stored_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields of conversations, each turn a new version of its conversation."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uid"), F.col("turn").alias("doc_id"), "text")
    versions = ingest.superseded(turns)
    newest = snapshot.live(versions).select(F.col("uid").alias("conv_id"), "text")
    return newest.join(statistics.histogram(versions, "uid").select(F.col("uid").alias("conv_id"), F.col("n").alias("versions")), "conv_id")


@_query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 7 + 1)::INTEGER AS file_id, (row_number() OVER (ORDER BY s_suppkey) - 1) % 7 AS \"offset\" FROM supplier")
def kv_put_rolls_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries appended to a log whose files end after seven, read again with their checksums."""
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(1).alias("t"))
    log = f"{scratch(spark)}/log"
    store.put(log, store.entries(rows, "s_suppkey", "s_name", "t", ["s_suppkey"], per_file=7))
    return store.checked(spark.read.parquet(log)).select(F.decode("key", "UTF-8").cast("long").alias("s_suppkey"), "file_id", "offset")


@_query("SELECT count(DISTINCT user_id) AS keys, count(*) AS entries, sum(strlen(user_id::VARCHAR) + strlen(CASE WHEN event_id % 7 = 0 THEN 'bitcask_tombstone' ELSE event_type END))::BIGINT AS bytes FROM events")
def kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(_log(spark, sf_dir))


# Streams

def _sent(events: DataFrame) -> DataFrame:
    """Events as sent documents, keyed by user, in order of arrival."""
    token = lambda c: F.array(F.struct(c.cast("string").alias("value"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("weight")))
    field = lambda name, c: F.struct(F.lit(name).alias("name"), F.lit("1").alias("tokenCount"), F.lit(True).alias("indexable"), token(c).alias("tokens"), F.lit(None).cast("int").alias("payload"))
    stored_ = F.struct(F.col("user_id").alias("uid"), F.create_map(F.lit("event_id"), F.col("event_id").cast("string")).alias("fields"))
    return events.select(F.col("user_id").cast("int").alias("object_id"), F.array(field("event_type", F.col("event_type")), field("event_id", F.col("event_id"))).alias("fields"), F.lit(None).cast("int").alias("timestamp"), stored_.alias("doc"), "event_id")


@_query(f"WITH {_LATEST} SELECT user_id, event_id::VARCHAR AS event_id, event_type FROM l WHERE superseded_by IS NULL")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a journal, and the index that the journal holds."""
    folder = scratch(spark)
    source = _table(spark, sf_dir, "events")
    fed = streaming.files(spark, source.schema, f"{sf_dir}/events.parquet*", pathGlobFilter="*.parquet")
    streaming.start(_sent(fed), f"{folder}/journal", f"{folder}/checkpoint", ["event_id"]).awaitTermination()
    index = streaming.recover(spark, f"{folder}/journal", newest_only=False, fields=["event_type"])
    alive = snapshot.live(index.docs).join(index.stored, "uid", "left")
    return alive.select(F.col("uid").alias("user_id"), F.col("fields")["event_id"].alias("event_id"), F.get(index.fields["event_type"].values, F.lit(0)).alias("event_type"))


@_query(f"WITH {_LATEST} SELECT user_id FROM l WHERE superseded_by IS NULL AND event_type = 'click'")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches in a journal, replayed; the second supersedes the first."""
    journal, events = f"{scratch(spark)}/journal", _table(spark, sf_dir, "events")
    middle = events.agg((F.max("event_id") / 2).cast("long")).first()[0]
    for half in (events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)):
        streaming.update(journal, _sent(half), ["event_id"])
    index = streaming.recover(spark, journal, fields=["event_type"])
    found = compiler.by_predicate(ast.Term("event_type", "click"), index)
    return index.docs.join(found, "doc_id", "left_semi").select(F.col("uid").alias("user_id"))


@_query(f"WITH {_LATEST} SELECT user_id, event_id::VARCHAR AS event_id FROM l WHERE superseded_by IS NULL")
def reingest_and_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is sent again changes nothing, nor does the compaction of the journal."""
    folder = scratch(spark)
    sent = _sent(_table(spark, sf_dir, "events"))
    for _ in range(2):
        streaming.append(f"{folder}/journal", sent, 0, ["event_id"])
    streaming.compact_journal(spark, f"{folder}/journal", f"{folder}/compact")
    index = streaming.recover(spark, f"{folder}/compact", fields=["event_type"])
    return index.stored.select(F.col("uid").alias("user_id"), F.col("fields")["event_id"].alias("event_id"))


# Functions and helpers

@_query(f"WITH {_P} SELECT 'text' AS field, term, row_number() OVER (ORDER BY term) AS term_id FROM (SELECT DISTINCT term FROM o)")
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms numbered in the order of their bytes."""
    return statistics.dictionary(_postings(spark, sf_dir).postings)


@_query("SELECT p_partkey, [p_size::BIGINT, NULL, -7] AS longs, [p_size, NULL, NULL]::INTEGER[] AS ints, true AS same, p_size AS sliced, (2 * length(p_name))::INTEGER AS utf16, (4 * length(p_name))::INTEGER AS utf32, true AS utf8, p_name AS back, [p_brand, p_size::VARCHAR] AS parts, true AS now FROM part")
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name, brand = F.col("p_size").cast("string"), F.col("p_name"), F.col("p_brand")
    same = scalars.hashed(name, size) == scalars.hashed(F.concat(name, F.lit("")), size)
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.to_longs(F.array(size, F.lit("2.5"), F.lit("-7"))).alias("longs"),
        scalars.to_ints(F.array(size, F.lit("x"), F.lit("99999999999"))).alias("ints"),
        same.alias("same"),
        scalars.parse_int(F.concat(F.lit("ab"), F.lpad(size, 4, "0"), F.lit("z")), 10, 2, 4).alias("sliced"),
        F.octet_length(scalars.utf16(name)).alias("utf16"),
        F.octet_length(scalars.utf32(name)).alias("utf32"),
        scalars.is_utf8(scalars.utf8(name)).alias("utf8"),
        scalars.from_utf8(scalars.utf8(name)).alias("back"),
        scalars.split_up(scalars.joined(brand, size)).alias("parts"),
        (F.abs(scalars.now_seconds() - F.unix_timestamp(F.current_timestamp())) < 5).alias("now"),
    )


@_query("SELECT p_partkey, true AS held, false AS other, 2 AS size, p_size AS least, (p_size + 70)::INTEGER AS later, p_size AS earlier, -1 AS none, [p_size + 70]::BIGINT[] AS without, [p_size]::BIGINT[] AS shared, true AS meets, false AS is_empty, 3 AS either, 1 AS one_only, 1 AS left_only FROM part")
def bitset_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of a part's size and of that and 70, against the set of the size and 1000."""
    size = F.col("p_size")
    one = bitsets.with_bit(bitsets.flipped(bitsets.empty(64), size), size + 70)
    two = bitsets.with_bit(bitsets.with_bit(bitsets.empty(64), size), F.lit(1000))
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        bitsets.get(one, size).alias("held"),
        bitsets.get(one, size + 1).alias("other"),
        bitsets.cardinality(one).alias("size"),
        bitsets.next_member(one, F.lit(0)).alias("least"),
        bitsets.next_member(one, size + 1).alias("later"),
        bitsets.previous_member(one, size + 69).alias("earlier"),
        bitsets.next_member(one, size + 71).alias("none"),
        bitsets.members(bitsets.without_bit(one, size)).cast("array<long>").alias("without"),
        bitsets.members(bitsets.both(one, two)).cast("array<long>").alias("shared"),
        bitsets.intersects(one, two).alias("meets"),
        bitsets.is_empty(one).alias("is_empty"),
        bitsets.cardinality(bitsets.either(one, two)).alias("either"),
        bitsets.cardinality(bitsets.left_only(two, one)).alias("one_only"),
        bitsets.cardinality(bitsets.left_only(one, two)).alias("left_only"),
    )


@_query(f"WITH {_P} SELECT doc_id, position::INTEGER AS position, (doc_id << 8) | (position & 255) AS packed, doc_id AS packed_doc, (position & 255)::INTEGER AS packed_position FROM o WHERE term = 'of'")
def posting_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir).postings.where((F.col("field") == "text") & (F.col("term") == "of"))
    packed = rows.withColumn("packed", scalars.pack_posting(F.col("doc_id"), F.col("position")))
    return packed.select("doc_id", "position", "packed", scalars.packed_doc(F.col("packed")).alias("packed_doc"), scalars.packed_position(F.col("packed")).alias("packed_position"))


@_query("SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 7")
def topn_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helpers.top_distinct(_table(spark, sf_dir, "part").select("p_size"), 7, "p_size")


@_query("SELECT k FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) ORDER BY k")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    return helpers.merged_in_order([suppliers.select(F.col("s_nationkey").alias("k")), customers.select(F.col("c_nationkey").alias("k"))], "k")


@_query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC LIMIT 1000000")
def order_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helpers.ordered_by(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", False)


@_query("SELECT n_name FROM nation WHERE n_name <> 'FRANCE'")
def all_but_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helpers.all_but(_table(spark, sf_dir, "nation").select("n_name"), "n_name", "FRANCE")


@_query("SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') AND ends_with(p_brand, '1')")
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return helpers.with_suffix(helpers.with_prefix(_table(spark, sf_dir, "part"), "p_brand", "Brand#1"), "p_brand", "1").select("p_partkey")


@_query("SELECT p_partkey, bit_count(p_size)::INTEGER AS ones, (p_size & (p_size - 1)) = 0 AS power, length(p_name)::INTEGER AS points, lower(hex(encode(p_name))) AS dump, p_brand || '_' || p_size AS joined, p_size AS parsed FROM part")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.popcount(size).cast("int").alias("ones"), scalars.is_power_of_two(size).alias("power"), scalars.code_points(name).alias("points"), scalars.hex_dump(scalars.utf8(name)).alias("dump"), scalars.joined(F.col("p_brand"), size.cast("string")).alias("joined"), scalars.parse_int(size.cast("string")).alias("parsed"))


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8: its bytes, one by one, through the usual table."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: xor(list_extract({table}::BIGINT[], (xor(c, b) & 255) + 1), c >> 8)), 4294967295)::BIGINT"


@_query(f"SELECT p_partkey, {crc32_sql('p_name')} AS crc FROM part")
def crc32_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.crc32(scalars.utf8(F.col("p_name"))).alias("crc"))
