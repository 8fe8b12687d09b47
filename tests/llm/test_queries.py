"""The registered corpus queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postora.llm import decontaminate, mixing, quality, queries, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    held = duckdb.connect()
    for f in os.listdir(DATA):
        held.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return held


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = tables.sql(queries.ORACLES[name])
    order = [wanted.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == sorted(repr([r[i] for i in order]) for r in wanted.fetchall())


def test_tokens_against_a_plain_pass(spark):
    vocabulary, known = tokens.Vocabulary.load(tokens.VOCABULARY), {}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.op8_tokens(spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        words = (texts[r["doc_id"]] or "").encode().split()
        for w in words:
            known[w] = known.get(w) or vocabulary.tokens(tokens.MARK + w)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_quality_against_a_plain_pass(spark):
    """Scores are the softmax over averaged vectors of a model trained on the rows outside the hold-out alone."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    keyed = spark.createDataFrame([(k, texts[k]) for k in labels if k in texts and not held(k)], "k long, t string")
    order = [r["k"] for r in keyed.select(F.xxhash64("k", "t").alias("h"), "k").orderBy("h", "k").collect()]
    model = quality.train([quality.occurrences(texts[k].encode()) for k in order], np.array([labels[k] for k in order]))
    for r in queries.op10_quality(spark, DATA).collect():
        ids, share = quality.occurrences(texts[r["doc_id"]].encode())
        logits = model.weights @ (share @ model.vectors[ids]) + model.bias
        score = 1 / (1 + np.exp(logits[0] - logits[1]))
        assert abs(r["score"] - score) < 1e-3 and r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.7)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


TEXT = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn while two children watch from afar"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties, repeated rows and columns named like those that operators add."""
    folder = str(tmp_path_factory.mktemp("small"))
    drawn = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(drawn.choices(words, k=40)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30, TEXT, "en", "s0"), (31, TEXT + " indeed", "en", "s1"), (32, None, "en", "s2"), (33, "", None, None), (None, rows[3][1], "en", None), rows[5], rows[5], (34, " ".join(drawn.choices(words, k=200000)), "en", "s0"), (7, "another text of seven " + " ".join(words[:30]), "en", "s1")]
    rows.append((35, "x y z " + " ".join(f"item{i}" for i in range(20)) + " q", "en", "s1"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name, value in {"quality_score": 0.0, "leak_found": "mine", "mix_positions": "mine", "mix_position": 7, "shard": "mine", "near_kept": False, "node": 1, "_ka": None}.items():
        frame = frame.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(30)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shown(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def test_stages_with_clashing_columns(spark, small):
    """Each stage against what its operator says of the same rows without the extra columns, in plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = docs.select("doc_id", "text", "source")
    rows = [r.asDict() for r in docs.collect()]
    text = {r["text"] for r in rows}
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {t: 1 / (1 + np.exp(-float(np.diff(model.weights @ (share @ model.vectors[ids]) + model.bias)[0]))) for t in text for ids, share in [quality.occurrences((t or "").encode())]}
    good = corpus_pipeline.good_documents(spark, docs, small)
    assert good.columns == docs.columns
    assert shown(good) == shown(docs.where(F.coalesce("text", F.lit("-")).isin([t if t is not None else "-" for t in text if scores[t] >= 0.5])))
    one = corpus_pipeline.one_of_each(spark, docs, small)
    assert one.columns == docs.columns and shown(one) == shown(docs.where("doc_id is null or doc_id <> 31"))
    clean = corpus_pipeline.without_leaks(spark, docs, small)
    assert clean.columns == docs.columns and shown(clean) == shown(docs.where("doc_id is null or doc_id <> 35"))
    takes = Counter()
    for r in mixing.mix(plain).collect():
        takes[r["doc_id"], r["text"]] += r["mix_takes"]
    mixed = corpus_pipeline.mixed(spark, docs, small)
    assert mixed.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +takes
    last = corpus_pipeline.sharded(spark, docs, small)
    assert last.columns == [*docs.columns, "shard_size", "shard_crc32", "_shard", "shard_slot", "shard_grown"] and shown(last.select(*docs.columns)) == shown(docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), small).count() == 0
    assert corpus_pipeline.run(spark, small).columns == last.columns


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    good = corpus_pipeline.good_documents(spark, docs, DATA).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns
    right = sum((k in kept) == bool(q) for k, q in labels.items())
    assert right / len(labels) > 0.9
    one = corpus_pipeline.one_of_each(spark, good, DATA).cache()
    sets = {r["doc_id"]: frozenset(zip(*[r["text"].lower().split()[i:] for i in range(5)])) for r in one.collect()}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and len(sets[a]) and len(sets[b]))
    clean = corpus_pipeline.without_leaks(spark, one, DATA).cache()
    assert all(not r["leak_found"] for r in decontaminate.leaks(clean, bench).collect())
    mixed = corpus_pipeline.mixed(spark, clean, DATA).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    last = corpus_pipeline.sharded(spark, mixed, DATA)
    slots = {}
    for r in last.collect():
        slots.setdefault(r["shard"], []).append(r["shard_slot"])
    assert last.count() == mixed.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert corpus_pipeline.run(spark, DATA).count() == last.count()
