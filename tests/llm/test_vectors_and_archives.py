from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from postora.llm import embeddings, warc


def brute(rows, least=0.95):
    def sound(e):
        return e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)

    good = [i for i, (k, e) in enumerate(rows) if k is not None and sound(e)]
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(good):
        for j in good[:n]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and (rows[i][1] == rows[j][1] or x @ y / np.sqrt((x @ x) * (y @ y)) >= least):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least_key = {}
    for i in good:
        least_key[find(i)] = min(least_key.get(find(i), rows[i][0]), rows[i][0])
    return [(k, links[i], least_key[find(i)] if i in good else k) for i, (k, _) in enumerate(rows)]


def vectors(n=300, size=24, seed=1):
    drawn = np.random.Generator(np.random.PCG64(seed))
    base = drawn.normal(size=(n // 10, size))
    rows = [(i, (base[i % len(base)] + drawn.normal(size=size) * 0.12).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (5, rows[9][1]), (1002, None), (1003, []), (1004, [0.0] * size), (1005, [float("nan")] * size), (1006, [1.0, None] * (size // 2)), (None, rows[0][1]), (1007, rows[0][1][:7]), (1008, [x * 3 for x in rows[0][1]]), (1009, [float("inf")] + [0.0] * (size - 1))]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "SQUARE", block)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    found = embeddings.near_vectors(frame).collect()
    got, wanted = sorted(((r["vec_id"], r["near_links"], r["near_component"]) for r in found), key=repr), sorted(brute(rows), key=repr)
    assert len(got) == len(wanted)
    recall = sum(n for _, n, _ in got) / sum(n for _, n, _ in wanted)
    assert 0.99 <= recall <= 1
    assert sum(a == b for a, b in zip(got, wanted)) >= 0.97 * len(wanted)
    assert embeddings.near_vectors(frame.where("false")).count() == 0


def at_cosine(pairs, size, cosine, seed):
    drawn = np.random.Generator(np.random.PCG64(seed))
    x, z = (embeddings.unit(drawn.normal(size=(pairs, size))) for _ in range(2))
    z = embeddings.unit(z - (z * x).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("size", [8, 64, 256, 1024])
@pytest.mark.parametrize("n", [1000, 10**8])
def test_recall_just_above_the_threshold(size, n):
    """Pairs at a cosine of 0.95 share a bucket, however many hashes so many vectors ask for."""
    x, y = at_cosine(150, size, 0.95, 3)
    plan = embeddings.planned(n, size, 0.95)
    kx, ky = embeddings.buckets(x, *plan), embeddings.buckets(y, *plan)
    assert (kx[:, :, :, None] == ky[:, :, None, :]).any((1, 2, 3)).mean() >= 0.97
    assert (2 * size) ** plan[1] >= n or plan[1] == embeddings.MOST_TURNS


def test_pairs_that_meet_in_near_buckets_only_are_counted(spark):
    x, y = at_cosine(4000, 256, 0.9505, 5)
    plan = embeddings.planned(8000, 256, 0.95)
    kx, ky = embeddings.buckets(x, *plan), embeddings.buckets(y, *plan)
    own = (kx[:, :, :1] == ky[:, :, :]).any((1, 2)) | (kx == ky[:, :, :1]).any((1, 2))
    near = np.flatnonzero(~own & (kx[:, :, :, None] == ky[:, :, None, :]).any((1, 2, 3)))[:5]
    assert len(near)
    rows = [(int(i), v.tolist()) for i, v in zip(range(2 * len(near)), np.concatenate([x[near], y[near]]))]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["near_links"], r["near_component"] % len(near) == r["vec_id"] % len(near)) for r in found} == {(1, True)}


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, "same"), (4, "u", ""), (5, "u", None), (6, "ü", "é" * 3000), (7, "u", "other"), (3, "again", "same"), (None, "u", "same"), (None, "u", "alone")]


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 16), (5, 100)])
def test_round_trip(spark, tmp_path, least, chunk):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    warc.records(frame, least_shared=least, chunk_bytes=chunk).write.parquet(str(tmp_path / "archive"))
    table = spark.read.parquet(str(tmp_path / "archive"))
    if chunk == 100:
        assert table.where("chunks > 1").count() == 60 and table.agg(F.max(F.length("bytes"))).first()[0] < 1000
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(table).collect()), key=repr)
    newest = {}
    for k, _, h in PAGES:
        if k is not None:
            newest[h or ""] = max(newest.get(h or "", k), k)
    wanted = []
    for k, _, h in PAGES:
        data = (h or "").encode()
        revisit = len(data) >= least and newest.get(h or "") not in (None, k)
        wanted.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", newest[h or ""] if revisit else None))
    assert got == sorted(wanted, key=repr)


def test_archives_are_warc_files(spark, tmp_path):
    """An exported archive, read by a parser that knows nothing but the format."""
    drawn = random.Random(1)
    pages = [(i, f"http://x/{i}", "z" * drawn.randint(0, 20)) for i in range(40)]
    table = warc.records(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), chunk_bytes=8)
    out = io.BytesIO()
    warc.export(table, 0, out)
    data, found, refers, uri_of, payload = out.getvalue(), {}, [], {}, {u: h for _, u, h in pages}
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        block, end, data = rest[:length], rest[length : length + 4], rest[length + 4 :]
        assert head.startswith(b"WARC/1.1\r\n") and end == b"\r\n\r\n"
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        if fields["WARC-Type"] == "revisit":
            refers.append((fields["WARC-Target-URI"], fields["WARC-Refers-To"]))
        else:
            assert fields["WARC-Record-ID"] not in uri_of
            uri_of[fields["WARC-Record-ID"]] = fields["WARC-Target-URI"]
            found[fields["WARC-Target-URI"]] = block.partition(b"\r\n\r\n")[2].decode()
    newest = {h: u for _, u, h in pages}
    assert found == {u: h for h, u in newest.items()}
    assert refers and all(uri_of[r] == newest[payload[u]] for u, r in refers)


def test_changed_archives_raise(spark):
    table = warc.records(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"))
    bad = table.withColumn("bytes", F.encode(F.replace(F.decode("bytes", "UTF-8"), F.lit("payload"), F.lit("paylaod")), "UTF-8"))
    with pytest.raises(Exception, match="was changed"):
        warc.read(bad).collect()
    assert warc.read(table.where("false")).count() == 0


def test_large_payloads_are_cut_as_they_lie():
    """A payload of 200 MB costs its writer some chunks of memory, and its reader one."""
    payload = memoryview(bytes(1 << 20) * 200)
    tracemalloc.start()
    reader, n = None, 0
    for _, i, count, data, _ in warc.chunks("r", warc._named(5, "d"), "response", "2024-01-01T00:00:00Z", "u", warc._base32(hashlib.sha1(payload).digest()), payload, None, warc.CHUNK):
        n += 1
        if i == 0:
            reader = warc.Reader(data)
        else:
            reader.feed(data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == count == 3200 and reader.done()[3] == len(payload) and most < 2 << 20
