"""Operators on texts against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postora.llm import decontaminate, frames, licenses, minhash, mixing, quality, sharding, substring, tokens
from postora.llm import text as tx
from postora.llm.frames import components, row_keys

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(seed=3, n=60):
    drawn = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "日本"]
    base = [" ".join(drawn.choices(vocabulary, k=drawn.randint(5, 120))) for _ in range(n)]
    passage = " ".join(drawn.choices(vocabulary, k=50))
    texts = list(base)
    for i in range(0, n, 3):
        words = base[i].split()
        for _ in range(max(1, len(words) // 40)):
            words[drawn.randrange(len(words))] = "edited"
        texts.append("\t".join(words))
        texts.append(f"{base[i]} {passage}\n{base[(i + 1) % n]}")
    texts += [base[0], base[0].upper(), "", None, "one", "one two", " \n ", "x" * 5000, "rep " * 80]
    return [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (8, "another text of eight"), (None, base[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, _a int, hits int")


def test_words_and_hashes_follow_python():
    texts = [t.encode() for _, t in corpus() if t is not None]
    words = tx.words_of(texts, tx.WHITE)
    split = [t.split() for t in texts]
    assert words.counts().tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert [words.word(i) for i in range(len(words))] == flat
    by_word = {}
    for w, h in zip(flat, words.hashes().tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_regular_words_and_runs_do_not_collide():
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    words = tx.words_of([f"{x} {y}".encode()], tx.WHITE)
    assert all(len(set(words.hashes(k).tolist())) == 2 for k in range(8)) and words.numbers().tolist() in ([0, 1], [1, 0])
    values = tx.words_of([" ".join(f"{x}{y}").encode()], tx.WHITE).hashes()
    assert all(tx.runs(values, 1024, k)[0] != tx.runs(values, 1024, k)[1024] for k in range(8))


def test_exact_sets_when_hashes_collide(monkeypatch):
    texts = [t.encode() for _, t in corpus() if t is not None]
    split = [t.split() for t in texts]
    monkeypatch.setattr(tx.Words, "hashes", lambda self, kind=0: np.zeros(len(self), np.uint64))
    for size in (1, 2, 5):
        sets, at = tx.exact_sets(tx.words_of(texts, tx.WHITE), size)
        own = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in split]
        assert np.diff(at).tolist() == [len(o) for o in own]
        for i in range(0, len(texts) - 1, 7):
            found = set(sets[at[i] : at[i + 1]].tolist()) & set(sets[at[i + 1] : at[i + 2]].tolist())
            assert len(found) == len(own[i] & own[i + 1])


def test_regular_words_are_neither_removed_nor_linked(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, " ".join(f"{x}{i}" for i in range(41))), (2, " ".join(f"{y}{i}" for i in range(41)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["repeat_removed"] for r in substring.remove_repeats(frame).collect()} == {0}
    found = minhash.near_duplicates(spark.createDataFrame([(1, f"{x} {x}"), (2, f"{y} {y}")], "doc_id long, text string"), shingle=2)
    assert {r["doc_id"]: r["near_component"] for r in found.collect()} == {1: 1, 2: 2}


def test_rows_of_one_key_keep_to_themselves(spark):
    """Null keys with texts of other lengths, in numbers at which short hashes of them would meet."""
    rows = spark.range(120000).select(F.lit(None).cast("long").alias("k"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("t"))
    a, b = row_keys("k", "t")
    assert rows.select(a.alias("a"), b.alias("b")).distinct().count() == 120000
    rows = spark.createDataFrame([(None, "x"), (0, "x"), (None, None), (None, ""), (0, None)], "k long, t string")
    assert rows.select(a.alias("a"), b.alias("b")).distinct().count() == 5


def test_lists_find_pairs_just_at_the_threshold():
    """Of ten thousand pairs of sets with similarities from 0.80 to 0.82 all share a run of retained values, and no
    union's least hashes fall below the bound."""
    drawn, missed = np.random.Generator(np.random.PCG64(11)), 0
    for _ in range(10000):
        union = int(drawn.integers(20, 400))
        both = int(np.ceil(union * drawn.uniform(0.80, 0.82)))
        values = drawn.integers(0, 1 << 63, union, dtype=np.uint64)
        left = int(drawn.integers(0, union - both + 1))
        x, y = np.sort(values[: both + left]), np.sort(np.concatenate([values[:both], values[both + left :]]))
        own = [{tuple(s[: minhash.K][i : i + 3].tolist()) for i in range(min(len(s), minhash.K) - 2)} for s in (x, y)]
        missed += not (own[0] & own[1] and minhash._may_be_alike(x, y, 80))
    assert missed == 0


@pytest.mark.parametrize("last", [frames._LAST_LINKS, 60, 0])
def test_components(spark, monkeypatch, last):
    """With all links joined by one task, with some rounds before that, and with rounds to the end."""
    monkeypatch.setattr(frames, "_LAST_LINKS", last)
    drawn = random.Random(1)
    edges = [(drawn.randrange(200), drawn.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for e in edges for x in e if e[0] != e[1]}
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_covers_hold_every_difference():
    for period in (1, 2, 7, 21, 33, 60):
        cover = substring.difference_cover(period)
        assert {(x - y) % period for x in cover for y in cover} == set(range(period))


@pytest.mark.parametrize("size", [2, 35])
def test_repeats(spark, docs, size):
    rows = docs.collect()
    split = [WHITE.findall(r["text"] or "") for r in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    wanted = []
    for r, w in zip(rows, split):
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        wanted.append((r["doc_id"], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    found = substring.remove_repeats(docs.withColumn("repeat_words", F.lit("mine")), size)
    assert "_repeat_words" in found.columns and found.select("repeat_words").distinct().first()[0] == "mine"
    got = [(r["doc_id"], r["_repeat_words"], r["repeat_removed"], r["repeat_kept"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert substring.remove_repeats(empty(spark)).count() == 0


def brute_classes(rows, shingle, percent):
    def of(t):
        w = WHITE.findall(lower(t or ""))
        return frozenset(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset()

    sets = [of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    live = [i for i, (k, _) in enumerate(rows) if k is not None and sets[i]]
    for x, i in enumerate(live):
        for j in live[:x]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(k, len(sets[i]), least[find(i)] if i in live else k) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize(("shingle", "percent"), [(2, 80), (1, 60)])
def test_near_duplicates(spark, docs, shingle, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = minhash.near_duplicates(docs.withColumn("node", F.lit("mine")), shingle=shingle, percent=percent).collect()
    got = [(r["doc_id"], r["near_shingles"], r["near_component"]) for r in found]
    assert sorted(got, key=repr) == sorted(brute_classes(rows, shingle, percent), key=repr)
    assert all(r["near_kept"] == (r["doc_id"] is None or r["doc_id"] == r["near_component"]) for r in found)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_a_family_of_edited_copies(spark):
    """Copies that pivots link, copies of copies that they don't, and texts that only share a passage."""
    drawn = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(drawn.randint(0, 9)):
            words[drawn.randrange(60)] = f"e{drawn.randrange(5000)}"
        rows.append((i, " ".join(words)))
    for i in range(150, 220):
        words = rows[drawn.randrange(150)][1].split()
        words[drawn.randrange(60)] = "again"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base[:30] + [f"o{i}_{k}" for k in range(30)])) for i in range(220, 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_ka", F.lit("mine"))
    kept = minhash.without_near_duplicates(frame, shingle=2)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in brute_classes(rows, 2, 80) if d == c)


def test_copies_share_one_list(spark):
    """Two texts that differ in a word have many runs in common, and one list."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:-1], "edited"])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id id", "text", "0L _a", "0L _b")
    with frames.tables() as own:
        nodes = own(frame.mapInArrow(minhash._sketches(2, "text", "id", minhash.K), minhash._SKETCHED).withColumnRenamed("id", "node"))
        found = minhash._lists(nodes, 80, own).collect()
    assert sorted(r["node"] for r in found) == [0, 1]
    assert len({r["v"] for r in found}) == 1


def test_a_filter_of_keys_lets_every_key_pass(spark, monkeypatch):
    keys = spark.range(0, 30000, 3).selectExpr("id a", "-id b")
    rows = spark.range(30000).selectExpr("id c0", "-id c1")
    passed = [r["c0"] for r in frames.with_chance(rows, ["c0", "c1"], keys, "chance").where("chance").collect()]
    assert set(range(0, 30000, 3)) <= set(passed) and len(passed) < 10400
    assert frames.with_chance(rows, ["c0", "c1"], keys.limit(0), "chance").where("chance").count() == 0
    monkeypatch.setattr(frames, "_FILTERED_KEYS", 9999)
    assert frames.with_chance(rows, ["c0", "c1"], keys, "chance").where("chance").count() == 30000


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_only_texts_in_lists_are_fetched(spark, monkeypatch, words):
    """However full the filter, the classes are the same; with room in it, texts without a list are held back."""
    monkeypatch.setattr(frames, "_FILTER_WORDS", words)
    held, whole = [], frames.with_chance

    def counted(*given):
        out = whole(*given)
        held.append((given[1], given[0].count(), out.where("_chance").count()))
        return out

    monkeypatch.setattr(minhash, "with_chance", counted)
    drawn = random.Random(2)
    rows = [(i, " ".join(f"w{drawn.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    rows += [(100 + i, f"{t} more") for i, t in rows[:4]]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted((r["doc_id"], r["near_shingles"], r["near_component"]) for r in found) == sorted(brute_classes(rows, 2, 80))
    texts = next(h for h in held if h[0] == ["_a", "_b"])
    assert texts[1] == 64 and 8 <= texts[2] <= (12 if words > 1 else 64)


def test_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    """Of rows with columns of their own only those that may go are joined with what goes."""
    held, whole = [], frames.with_chance

    def counted(*given):
        out = whole(*given)
        held.append((given[0].columns, out.where("_chance").count()))
        return out

    monkeypatch.setattr(minhash, "with_chance", counted)
    drawn = random.Random(5)
    rows = [(i, " ".join(f"w{drawn.randrange(10**6)}" for _ in range(40)), "x") for i in range(50)]
    rows += [(100, rows[0][1], "y"), (100, rows[0][1], "z"), (101, f"{rows[1][1]} more", "y"), (None, rows[0][1], "y"), (None, None, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _chance string")
    kept = minhash.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if r[0] not in (100, 101)), key=repr)
    assert held[-1][0][:3] == ["c0", "c1", "c2"] and 3 <= held[-1][1] <= 6


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "APACHE license apache  license; the MIT-License and CC_BY"),
        (3, "licensed under the apache license version 2"),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "licensed under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
        (6, "Licensed under CC BY-NC 4.0. Released under the MIT License"),
        (7, None), (8, ""), (9, "apache licensee"), (1, "Licensed under the Apache License, Version 2.0."),
        (10, licenses._MARK.sub(" ", licenses.TEMPLATES["mit"][2]).replace("  BE", " authors or copyright holders BE")),
        (11, licenses._MARK.sub(" ", licenses.TEMPLATES["mit"][2]).replace("merge", "marge")),
        (12, "This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (13, licenses._MARK.sub(" ", licenses.TEMPLATES["bsd-3-clause"][0]).replace("name of", "name of the Foo Project")),
        (14, licenses._MARK.sub(" ", licenses.TEMPLATES["bsd-2-clause"][0])),
        (15, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, text string").withColumn("license_found", F.lit(0))
    found = {(r["doc_id"]): r["_license_found"] for r in licenses.scan(frame).collect()}
    labels = {k: (v["base_labels"], v["labels"]) for k, v in found.items()}
    assert labels[1] == (["apache"], ["apache", "apache-2.0"])
    assert labels[2] == (["apache", "cc-by", "mit"], ["apache", "cc-by", "mit"]) and (found[2]["base"], found[2]["first"], found[2]["last"]) == (4, 0, 8)
    assert labels[3] == (["apache"], ["apache"])
    assert labels[4][1] == ["gpl", "gpl-3.0-only"] and labels[5][1] == ["gpl", "gpl-2.0-only"]
    assert labels[12][1] == ["gpl", "gpl-3.0-or-later"] and labels[13][1] == ["bsd-3-clause"] and labels[14][1] == ["bsd-2-clause"] and labels[15][1] == ["mpl-2.0"]
    assert labels[6][1] == ["cc-by", "cc-by-nc-4.0", "mit"]
    assert found[7]["words"] == found[8]["words"] == 0 and found[7]["first"] is None
    assert labels[9] == ([], []) and labels[10] == ([], ["mit"]) and labels[11] == ([], [])
    assert licenses.scan(empty(spark)).count() == 0


def test_license_bases_by_brute_force(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    frame = docs.withColumn("text", F.concat_ws(" MIT license,", "text", F.lit("Apache\tLICENSE cc by"), "text"))
    for r in licenses.scan(frame).collect():
        words = word.findall(lower(r["text"]))
        at = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        f = r["license_found"]
        assert (f["words"], f["base"], f["first"], f["last"]) == (len(words), len(at), min(at), max(at))


def test_templates():
    t = licenses.Template("alpha beta <<optional>>x <<optional>>y<<end>><<end>> <<any:2>> gamma <<one:v\\d+>>")
    accepts = lambda s: t.accepts(s.split())
    assert accepts("alpha beta gamma v1") == 4 and accepts("alpha beta x gamma v1 tail") == 5 and accepts("alpha beta x y q gamma v22") == 7
    assert accepts("alpha beta a b c gamma v1") == 0 and accepts("alpha beta gamma w1") == 0
    for bad in ("alpha", "<<any:2>> alpha beta", "a b <<optional>> c"):
        with pytest.raises(ValueError):
            licenses.Template(bad)


def brute_leaks(text, items, shingle=5, least=0.8):
    def bag(w):
        g = min(shingle, len(w))
        return Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1)) if w else Counter()

    words, out = WHITE.findall(lower(text or "")), {}
    for key, item in items:
        own = WHITE.findall(lower(item or ""))
        n = min(len(own), len(words))
        for i in range(len(words) - n + 1) if n else []:
            x, y = bag(words[i : i + n]), bag(own)
            s = sum((x & y).values()) / sum((x | y).values())
            if s >= least:
                out[key] = max(out.get(key, 0), s)
    return out


def test_leaks(spark):
    drawn = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(drawn.choices(vocabulary, k=drawn.randint(3, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "solo")]
    texts = []
    for i in range(60):
        own = drawn.choices(vocabulary, k=drawn.randint(0, 150))
        item = items[i % 25][1].split()
        if i % 4 == 1:
            item[-1] = "changed"
        if i % 4 == 2:
            item = item[1:]
        own[i % (len(own) + 1) : i % (len(own) + 1)] = item if i % 4 != 3 else []
        texts.append((i, (" ".join(own)).upper()))
    texts += [(100, None), (101, ""), (102, "Solo"), (103, items[3][1]), (103, items[3][1])]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame.withColumn("leak_found", F.lit(1)), bench)
    for r in found.collect():
        wanted = brute_leaks(r["text"], items)
        assert {h["item"]: round(h["similarity"], 9) for h in r["_leak_found"]} == {k: round(v, 9) for k, v in wanted.items()}, r
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert all(not r["leak_found"] for r in decontaminate.leaks(frame, bench.where("false")).collect())


def test_items_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(5)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x a0 b0 c0 d0 e0 f0 y a4 b4 c4 d4 e4 f4 z")], "doc_id long, text string")
    assert [h["item"] for h in decontaminate.leaks(rows, bench).first()["leak_found"]] == [0, 4]


def test_every_fingerprint_within_the_radius_is_found():
    drawn = np.random.Generator(np.random.PCG64(2))
    index = decontaminate.Index(list(range(40)), 5).build([" ".join(f"t{i}x{k}" for k in range(20)).encode() for i in range(40)])
    prints = index.prints.copy()
    for i in range(40):
        for b in drawn.choice(64, decontaminate.RADIUS, replace=False):
            prints[i, 0] ^= np.uint64(1) << np.uint64(b)
        prints[i, 1:] = ~prints[i, 1:]
    window, item = index.within(prints, 20)
    assert set(zip(range(40), range(40))) <= set(zip(window.tolist(), item.tolist()))


def test_token_counts(spark, docs):
    vocabulary = tokens.Vocabulary.load(tokens.VOCABULARY)
    known = {}
    for r in tokens.count(docs.withColumn("token_count", F.lit(1))).collect():
        words = [w.encode() for w in WHITE.findall(r["text"] or "")]
        for w in words:
            if w not in known:
                known[w] = vocabulary.tokens(tokens.MARK + w)
        assert (r["_token_count"]["tokens"], r["_token_count"]["words"]) == (sum(known[w] for w in words), len(words))
    assert tokens.count(empty(spark)).count() == 0


def test_segmentation_is_best():
    vocabulary = tokens.Vocabulary([b"a", b"b", b"ab", b"abc", b"c", b"bcd"])

    def best(w):
        if not w:
            return 0.0, 0
        options = [(vocabulary.alone + best(w[1:])[0], -1 + best(w[1:])[1])]
        options += [(vocabulary.score[w[:n]] + best(w[n:])[0], -1 + best(w[n:])[1]) for n in range(1, len(w) + 1) if w[:n] in vocabulary.score]
        return max(options)

    assert tokens.Vocabulary([]).tokens(b"abc") == 3 and tokens.trie_counts([b"abc"], tokens.Vocabulary([])).tolist() == [3]
    drawn = random.Random(2)
    words = sorted({bytes(drawn.choices(b"abcdz", k=drawn.randint(1, 7))) for _ in range(200)})
    assert tokens.trie_counts(words, vocabulary).tolist() == [-best(w)[1] for w in words] == [vocabulary.tokens(w) for w in words]


def test_mixing(spark):
    drawn = random.Random(6)
    rows = [(i, " ".join(["w"] * drawn.randint(0, 40)), drawn.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    rows += [(600, None, "a"), (601, "", None), (5, rows[5][1], rows[5][2]), (700, "w w w", "tiny"), (None, "w", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_size", F.lit(-1))
    found = mixing.mix(frame).collect()
    assert len(found) == len(rows) and all(r["mix_size"] == -1 for r in found)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free_)
        over = [s for s in free_ if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    target |= {s: level * weight[s] for s in free_}
    taken = Counter()
    for r in found:
        size = len((r["text"] or "").split())
        assert r["_mix_size"] == size and abs(r["mix_target"] - target[r["source"]]) < 1e-6 and r["mix_source_size"] == sizes[r["source"]]
        assert 0 <= r["mix_takes"] <= 3 and r["mix_positions"] == sorted(r["mix_positions"]) and all(0 <= p <= 1 for p in r["mix_positions"])
        taken[r["source"]] += r["mix_takes"] * size
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    again = mixing.mix(frame.repartition(7).withColumn("mix_position", F.lit("mine")))
    assert {(r["doc_id"], r["source"], r["mix_takes"]) for r in again.collect()} == {(r["doc_id"], r["source"], r["mix_takes"]) for r in found}
    played = mixing.in_training_order(again).select("_mix_position", "mix_position").collect()
    assert [p[0] for p in played] == sorted(p[0] for p in played) and {p[1] for p in played} == {"mine"}
    assert mixing.mix(empty(spark)).count() == 0


def test_schedules_are_inverted(spark):
    knots = ((0.0, 2.0), (0.3, 0.5), (1.0, 1.5))
    total = 0.3 * 1.25 + 0.7 * 1.0
    shares = [i / 50 for i in range(51)]
    times = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing._inverted(F.col("s"), knots)).collect()]
    for s, t in zip(shares, times):
        grid = np.linspace(0, t, 20001)
        area = np.trapezoid(np.interp(grid, [k for k, _ in knots], [d for _, d in knots]), grid) / total
        assert abs(area - s) < 1e-5


def test_draws_by_brute_force(spark, docs):
    def drawn(path, nodes, key):
        draws = [-np.log((int(hashlib.md5(f"{path}/{n.name}|{key}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / n.weight for n in nodes]
        n = nodes[int(np.argmin(draws))]
        return n.shard if n.shard is not None else drawn(f"{path}/{n.name}", n.children, key)

    tree = sharding.Topology.even(10, 3, 2).reweighted(4, 2.5)
    for r in sharding.assign(docs, tree).collect():
        key = "" if r["doc_id"] is None else f"={r['doc_id']}"
        assert (r["shard"], r["shard_grown"]) == (drawn("", tree.regions, key), drawn("", tree.grown().regions, key))


def test_sharding(spark, docs):
    tree = sharding.Topology.even(16)
    rows = sharding.assign(docs.withColumn("shard", F.lit("x")), tree).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} == {"x"}
    slots = {}
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["shard_size"] == len(data) + 1 and r["shard_crc32"] == zlib.crc32(data)
        assert r["shard_grown"] in (r["_shard"], 16)
        slots.setdefault(r["_shard"], []).append(r["shard_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty(spark), tree).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.Topology.even(16)
    at = lambda t: {r["doc_id"]: r["s"] for r in sharding.place(keys, "doc_id", t, "s").collect()}
    before, heavier, grown = at(tree), at(tree.reweighted(5, 3.0)), at(tree.grown().grown())
    counts = Counter(before.values())
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.35 * 250
    rack = lambda s: s // 4
    for k, s in before.items():
        if heavier[k] != s:  # into the heavier rack's region, or from rack to rack of it
            assert heavier[k] // 8 == 0
            assert s // 8 == 1 or rack(heavier[k]) == 1
        assert grown[k] in (s, 16, 17)
    assert Counter(heavier.values())[5] > 1.8 * counts[5]


def test_quality(spark):
    drawn = random.Random(9)
    good = [f"g{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [w + ("###" if bad and drawn.random() < 0.5 else "") for w in drawn.choices(good, k=drawn.randint(5, 60))]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    rows += [(2000, None), (2001, ""), (None, "text"), (3, rows[3][1])]
    labels += [(5000, 1), (None, 1), (7, None), (9, 5)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, known, most_rows=400)
    scored = quality.score(docs.withColumn("quality_score", F.lit(5)), model).collect()
    assert len(scored) == len(rows) and all(0 <= r["_quality_score"] <= 1 for r in scored)
    held = [r for r in scored if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["_quality_score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in held)
    assert right / len(held) > 0.97
    plain = 1 / (1 + np.exp(-float(np.diff(model.bias)[0])))
    assert abs(next(r for r in scored if r["doc_id"] == 2001)["_quality_score"] - plain) < 1e-6
    # the folded table is the softmax over averaged vectors
    ids, share = quality.occurrences(rows[1][1].encode())
    logits = model.weights @ (share @ model.vectors[ids]) + model.bias
    assert abs(next(r for r in scored if r["doc_id"] == 1)["_quality_score"] - np.exp(logits[1]) / np.exp(logits).sum()) < 1e-4
    nothing = quality.fit(docs, known.where("false"))
    assert all(r["quality_score"] == 0.5 for r in quality.score(docs, nothing).collect())
    assert quality.score(empty(spark), model).count() == 0


def test_holdout(spark, docs):
    for r in docs.withColumn("h", quality.in_holdout("doc_id")).collect():
        assert r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
