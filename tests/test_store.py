from __future__ import annotations

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from postora.functions import bitsets, scalars
from postora.operators import helpers
from postora.sources import store
from postora.sources.tables import numbered
from postora.streaming import ingest as streaming


def log_of(spark, rows):
    frame = spark.createDataFrame([(k.encode(), v.encode(), t, f, o) for k, v, t, f, o in rows], "key binary, value binary, tstamp int, file_id int, offset long")
    return frame.withColumn("crc", store.crc(F.col("key"), F.col("value"), F.col("tstamp")))


ROWS = [("a", "1", 1, 1, 0), ("a", "2", 1, 1, 9), ("a", "3", 0, 2, 0), ("b", "x", 5, 1, 3), ("b", store.TOMBSTONE.decode(), 6, 2, 4), ("c", "y", 2, 2, 5)]


def shown(df):
    return {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in df.collect()}


def test_newest_deleted_and_expired(spark):
    log = log_of(spark, ROWS)
    assert shown(store.visible(log)) == {"a": "2", "c": "y"}
    assert shown(store.visible(log, now=10, expiry_secs=8)) == {"c": "y"}
    assert shown(store.get(log, b"a", b"b")) == {"a": "2"}
    assert shown(store.visible(store.merged(log))) == shown(store.visible(log))
    assert store.fold_keys(log, F.count("*").alias("n")).first()[0] == 3
    cached = store.Cached(log, size=2)
    assert shown(cached.get(b"c")) == {"c": "y"} and shown(cached.get(b"c", b"b")) == {"c": "y"}
    assert (cached.hits, cached.misses, cached.evictions) == (1, 2, 0)
    assert shown(cached.get(b"a")) == {"a": "2"} and list(cached.held) == [b"b", b"a"] and cached.evictions == 1
    cached.resize(1)
    assert list(cached.held) == [b"a"] and cached.evictions == 2
    cached.clear()
    assert not cached.held and {r["value"]: r["n"] for r in store.fold(log, F.count("*").alias("n"), by=[F.decode("value", "UTF-8").alias("value")]).collect()} == {"2": 1, "y": 1}


def test_changed_entries_raise(spark):
    bad = log_of(spark, ROWS).withColumn("value", F.when(F.col("key") == b"c", F.lit(b"z")).otherwise(F.col("value")))
    assert store.checked(log_of(spark, ROWS)).count() == 6
    with pytest.raises(Exception, match="bad checksum"):
        store.checked(bad).collect()


def test_merge_plan(spark):
    plan = {r["file_id"]: r["action"] for r in store.merge_plan(log_of(spark, ROWS + [("a", "0", 0, 3, 0)])).collect()}
    assert plan == {1: "keep", 2: "keep", 3: "drop"}
    many = log_of(spark, [(f"k{i}", "v", 1, i, 0) for i in range(5)])
    assert {r["action"] for r in store.merge_plan(many).collect()} == {"compact"}
    assert {r["action"] for r in store.merge_plan(many, writing=4).collect()} == {"keep"}


def test_files_are_merged_one_by_one(spark, tmp_path):
    """Small files become one, a dead one goes, a full one stays as it is; a mark of deletion stays while it hides an entry."""
    rows = [(f"k{i}", "old", 0, 1, i) for i in range(1000)]
    rows += [("k0", store.TOMBSTONE.decode(), 1, 2, 0), ("gone", "x", 0, 3, 0), ("gone", store.TOMBSTONE.decode(), 1, 4, 0), ("dead", "a", 0, 5, 0), ("dead", "b", 1, 6, 0), ("new", "v", 1, 7, 0), ("n2", "v", 1, 8, 0)]
    log = str(tmp_path / "log")
    store.put(log, log_of(spark, rows))
    kept = (tmp_path / "log" / "file_id=1").stat().st_mtime_ns
    before = shown(store.visible(spark.read.parquet(log)))
    assert store.merge_files(spark, log) == {"drop": [3, 5], "compact": [2, 4, 6, 7, 8], "merge": [], "keep": [1]}
    after = store.checked(spark.read.parquet(log))
    assert shown(store.visible(after)) == before and "k0" not in before and len(before) == 1002
    assert (tmp_path / "log" / "file_id=1").stat().st_mtime_ns == kept
    assert {r[0]: r[1] for r in after.groupBy("file_id").count().collect()} == {1: 1000, 9: 4}
    found = store.stats(after, log).first()
    assert found["entries"] == 1004 and found["files"] >= 2 and found["disk_bytes"] > 0


def test_checksums_of_odd_entries(spark):
    frame = spark.createDataFrame([(b"k", b"v", -5), (b"k", b"v", -6)], "key binary, value binary, tstamp int")
    assert [r[0] for r in frame.select(store.crc(F.col("key"), F.col("value"), F.col("tstamp"))).collect()] == [zlib.crc32(struct.pack(">iHI", t, 1, 1) + b"kv") for t in (-5, -6)]
    long_ = spark.range(1).select(F.repeat(F.lit("k"), 65536).alias("k"), F.lit("v").alias("v"), F.lit(1).alias("t"), "id")
    with pytest.raises(Exception, match="too long"):
        store.entries(long_, "k", "v", "t", ["id"]).collect()


def test_entries_and_put(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit("v").alias("v"), F.lit(3).alias("t"), "id")
    made = store.entries(rows, "k", "v", "t", ["id"], per_file=4)
    store.put(str(tmp_path / "log"), made)
    log = store.checked(spark.read.parquet(str(tmp_path / "log")))
    assert sorted((r["file_id"], r["offset"]) for r in log.collect()) == [(1 + i // 4, i % 4) for i in range(10)]


def test_numbers_follow_the_order(spark):
    frame = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r["x"] + 1 == r["doc_id"] for r in numbered(frame, ["x"]).collect())
    assert numbered(frame.where("x < 0"), ["x"]).count() == 0
    same = numbered(frame.withColumn("y", F.lit(1)), ["y"])
    assert sorted(r["doc_id"] for r in same.collect()) == list(range(1, 1001))


def test_journal_replay_and_idempotence(spark, tmp_path):
    kind = "object_id int, fields array<struct<name:string,tokenCount:string,indexable:boolean,tokens:array<struct<value:string,position:int,weight:int>>,payload:int>>, timestamp int, segmentationHost string, shardIdx int, doc struct<uid:bigint,fields:map<string,string>>"
    batch = lambda *rows: spark.createDataFrame([(u, [("f", "1", True, [(t, None, None)], None)], None, None, None, (u, {"t": t})) for u, t in rows], kind)
    journal = str(tmp_path / "journal")
    assert streaming.update(journal, batch((1, "a"), (2, "b"))).code == 0
    assert streaming.update(journal, batch((1, "c"))).code == 0
    assert streaming.append(journal, batch((1, "c")), 1).code == 0  # run again
    index = streaming.recover(spark, journal)
    assert {(r["uid"], *r[index.fields["f"].values]) for r in index.docs.collect()} == {(1, "c"), (2, "b")}
    assert {r["uid"]: r["fields"] for r in index.stored.collect()} == {1: {"t": "c"}, 2: {"t": "b"}}
    streaming.compact_journal(spark, journal, str(tmp_path / "compact"))
    assert streaming.recover(spark, str(tmp_path / "compact")).docs.count() == 2
    # two writers that find the same batches have numbers of their own
    assert streaming.claimed(spark, journal) == 2 and streaming.claimed(spark, journal) == 3
    assert streaming.update(journal, batch((9, "z"))).code == 0
    assert streaming.recover(spark, journal).docs.count() == 3
    bad = batch((5, "x")).withColumn("object_id", F.lit(None).cast("int"))
    assert streaming.update(journal, bad).code == 1


def test_a_stream_takes_some_files_at_a_time_and_is_searched_meanwhile(spark, tmp_path):
    from postora.plans.ast import Term
    from postora.plans.compiler import by_predicate

    kind = "object_id int, fields array<struct<name:string,tokenCount:string,indexable:boolean,tokens:array<struct<value:string,position:int,weight:int>>,payload:int>>, timestamp int, segmentationHost string, shardIdx int, doc struct<uid:bigint,fields:map<string,string>>"
    for n in range(3):
        spark.createDataFrame([(n, [("f", "1", True, [("t", None, None)], None)], None, None, None, None)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    journal, seen = str(tmp_path / "journal"), []

    def after(batch, number):
        index = streaming.recover(spark, journal, fields=["f"])
        top = index.docs.agg(F.max("doc_id")).first()[0]
        seen.append((number, batch.count(), by_predicate(Term("f", "t"), index, top).count()))

    fed = streaming.files(spark, spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "in"), most_files=1)
    streaming.start(fed, journal, str(tmp_path / "checkpoint"), after=after).awaitTermination()
    assert seen == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]


def test_bitsets(spark):
    drawn, rows = random.Random(3), []
    for _ in range(12):
        rows.append(([drawn.randrange(130) for _ in range(drawn.randint(0, 6))] + drawn.choice([[], [63], [127]]), [drawn.randrange(200) for _ in range(drawn.randint(0, 4))], drawn.randrange(140)))
    words = lambda s, n: [(v - (1 << 64) if v >= 1 << 63 else v) for v in (sum(1 << (i - 64 * w) for i in s if i // 64 == w) for w in range(n))]
    frame = spark.createDataFrame([(words(set(x), 3), words(set(y), 4), i) for x, y, i in rows], "x array<long>, y array<long>, i int")
    x, y, i = F.col("x"), F.col("y"), F.col("i")
    found = frame.select(
        *[bitsets.members(c).alias(n) for n, c in {"with": bitsets.with_bit(x, i), "without": bitsets.without_bit(x, i), "flipped": bitsets.flipped(x, i), "both": bitsets.both(x, y), "either": bitsets.either(x, y), "one": bitsets.one_only(x, y), "left": bitsets.left_only(x, y)}.items()],
        bitsets.get(x, i).alias("get"), bitsets.next_member(x, i).alias("next"), bitsets.previous_member(x, i).alias("previous"), bitsets.intersects(x, y).alias("meets"), bitsets.is_empty(x).alias("none"), bitsets.cardinality(x).alias("n"),
    ).collect()
    for (x, y, i), r in zip(rows, found):
        x, y = set(x), set(y)
        assert [set(r[k]) for k in ("with", "without", "flipped", "both", "either", "one", "left")] == [x | {i}, x - {i}, x ^ {i}, x & y, x | y, x ^ y, x - y]
        assert (r["get"], r["meets"], r["none"], r["n"]) == (i in x, bool(x & y), not x, len(x))
        assert (r["next"], r["previous"]) == (min((m for m in x if m >= i), default=-1), max((m for m in x if m <= i), default=-1))


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.pack_posting(F.lit(5), F.lit(258)).alias("p"),
        scalars.parse_int(F.lit("-7f"), 16).alias("hex"),
        scalars.parse_int(F.lit("2147483648")).alias("big"),
        scalars.parse_int(F.lit(" 7")).alias("blank"),
        scalars.to_ints(F.array(F.lit("1"), F.lit("x"), F.lit("2.5"))).alias("ints"),
        scalars.trailing_zeros(F.lit(40)).alias("ntz"),
        scalars.next_power_of_two(F.lit(33)).alias("next"),
        scalars.next_power_of_two(F.lit(64)).alias("same"),
        scalars.is_power_of_two(F.lit(48)).alias("is"),
        F.length(scalars.utf32(F.lit("aé"))).alias("wide"),
        scalars.is_utf8(F.lit(b"\xff")).alias("utf8"),
        scalars.split_up(scalars.joined(F.lit("1"), F.lit("2"))).alias("parts"),
    ).first()
    assert row.asDict() == {"p": 5 << 8 | 2, "hex": -127, "big": None, "blank": None, "ints": [1, None, None], "ntz": 3, "next": 64, "same": 64, "is": False, "wide": 8, "utf8": False, "parts": ["1", "2"]}


def test_helpers(spark):
    frame = spark.createDataFrame([(3,), (1,), (1,), (None,)], "x int")
    assert [r[0] for r in helpers.top_distinct(frame.where("x is not null"), 2, "x").collect()] == [1, 3]
    assert [r[0] for r in helpers.merged_in_order([frame, frame], F.asc_nulls_last("x")).collect()] == [1, 1, 1, 1, 3, 3, None, None]
    assert helpers.all_but(frame, "x", 1).count() == 2
