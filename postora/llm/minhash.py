"""Near-duplicates by bottom-k sketches of one hash function.

A document's shingles are hashed once; its sketch is the `K` least hashes. The K least hashes of the union of two
documents fall into both sets independently at the rate of the similarity, so two documents at the threshold have
several of them in a row that both sketches retain. Inverted lists are kept by such runs of retained values: a run of
three for a similarity of 0.8 is missing for 4 pairs in 100 million just at the threshold, for fewer above, and for none
where the sketches are the whole sets (documents of 5 shingles or fewer are listed by shorter runs too). Lists of single
values would grow faster than the corpus, as common shingles are retained by very many unrelated documents; their
neighbours in those documents' sketches differ.

A list is linked by pivots: its members are compared with the one of them that stands in the longest lists, and only
members of different classes are compared further. Members that a pivot links need no comparison among themselves, so a
list of m copies costs m pairs and not m * m. What pivots leave apart is compared pair by pair, none left out: pairs
whose sketches, as bitmaps, can't share enough are dropped within the block of a list that they meet in, and the others
gathered by family, so that a document's text goes to a block of its family once and not to each pair. There the union
of two sketches estimates the similarity, with room for five standard deviations, and the full sets of shingles decide,
compared word by word and not by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postora.llm import text as tx
from postora.llm.frames import anonymous, bucketed, components, cut, forget, groups_of, in_small_batches, row_keys, tables, with_chance

K = 48
#: Least hashes that a sketch's bitmap holds, and its words of 64 bits. Sets of up to so many are held whole.
MAPPED, _MAP = 256, 32
#: Sets of so few shingles are listed by runs of every length up to the usual one.
FEW = 5
#: Rounds of pivots at most before the rest is compared pair by pair.
ROUNDS = 6
#: Documents of a part of a family, and of a part of a list; each two parts are a block.
BLOCK, LISTED = 64, 1024
#: Bytes of text that a block compares at once; a block of more is compared a pair at a time.
BLOCK_TEXT = 8 << 20
_SKETCHED = "id long, a long, b long, n int, same1 long, same2 long, sketch array<long>, map binary"


def _sketches(size: int, text: str, key: str, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.blocks(batches, text):
            found, at = tx.shingle_sets(tx.words_of(texts, tx.WHITE, lower=True), size)
            n = np.diff(at)
            kept = np.minimum(n, k)
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(kept, out=offsets[1:])
            values = found[np.repeat(at[:-1], kept) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], kept)] >> np.uint64(1)
            signed = lambda x: pa.array(x.view(np.int64))
            most = np.minimum(n, MAPPED)
            of = np.repeat(np.arange(len(n)), most)
            bits = tx.mixed(found[np.repeat(at[:-1] - np.cumsum(most) + most, most) + np.arange(most.sum())]) >> np.uint64(53)
            maps = np.zeros((len(n), _MAP), np.uint64)
            np.bitwise_or.at(maps, (of, (bits >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bits & np.uint64(63)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (key, "_a", "_b")]
            yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), *columns[1:], pa.array(n.astype(np.int32)), signed(tx.sums(found, at, 3)), signed(tx.sums(found, at, 4)), pa.ListArray.from_arrays(pa.array(offsets), signed(values)), pa.array([m.tobytes() for m in maps], pa.binary())], names=["id", "a", "b", "n", "same1", "same2", "sketch", "map"])

    return rows


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of exact shingles reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _may_be_alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the least hashes of the union of two sets leave the threshold within five standard deviations."""
    p = percent / 100
    union, counts = np.unique(np.concatenate([x[:MAPPED], y[:MAPPED]]), return_counts=True)
    union, counts = union[:MAPPED], counts[:MAPPED]
    return (counts == 2).sum() >= len(union) * p - 5 * (len(union) * p * (1 - p)) ** 0.5


def _compared(texts: list[bytes], pairs: list[tuple[int, int]], size: int, percent: int) -> list[tuple[int, int]]:
    """Of pairs of texts those whose shingles reach the threshold."""
    if len(texts) > 2 and sum(map(len, texts)) > BLOCK_TEXT:
        return [(i, j) for i, j in pairs if _compared([texts[i], texts[j]], [(0, 1)], size, percent)]
    words = tx.words_of(texts, tx.WHITE, lower=True)
    hashes, at = tx.shingle_sets(words, size)
    likely = [(i, j) for i, j in pairs if _may_be_alike(hashes[at[i] : at[i + 1]], hashes[at[j] : at[j + 1]], percent)]
    if not likely:
        return []
    sets, at = tx.exact_sets(words, size)
    return [(i, j) for i, j in likely if _alike(sets[at[i] : at[i + 1]], sets[at[j] : at[j + 1]], percent)]


def _verified(size: int, percent: int):
    """Rows of a block's key: first the texts of its nodes (b null), then its pairs a, b. Returns the pairs that reach
    the threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches, ("k1", "k2")):
            a, b = group.column("a").to_numpy(), group.column("b").to_pylist()
            n = sum(x is None for x in b)
            texts = [bytes(t.as_buffer()) if t.is_valid else b"" for t in group.column("text").slice(0, n)]
            place = {k: i for i, k in enumerate(a[:n].tolist())}
            found = _compared(texts, [(place[x], place[y]) for x, y in zip(a[n:].tolist(), b[n:])], size, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(a[p[k]]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows


def _similar(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs k1, k2, a, b (stored) those that reach the threshold; k1, k2 name blocks, to which each text goes once."""
    ends = pairs.select("k1", "k2", "a").union(pairs.select("k1", "k2", "b")).distinct()
    held = ends.join(texts, ends["a"] == texts["node"]).select("k1", "k2", "a", F.lit(None).cast("long").alias("b"), "text")
    both = held.union(pairs.select("k1", "k2", "a", "b", F.lit(None).cast("string")))
    return both.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.asc_nulls_first("b")).mapInArrow(_verified(size, percent), "a long, b long")


def _pairs_of(node: np.ndarray, root: np.ndarray, n: np.ndarray, maps: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `left` and `right` of pairs of other nodes and roots that may reach the threshold.

    Their sizes can, and the bitmaps of their least hashes share as many values as the union needs: the share of the
    threshold less five standard deviations or, of sets that the bitmaps hold whole, what it asks. Bits in common are
    as many as shared values but for those that fall on one bit in either set.
    """
    p, xs, ys = percent / 100, [], []
    held = np.minimum(n, MAPPED)
    lost = held - np.bitwise_count(maps).sum(1)
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        bits = np.zeros((len(x), len(right)), np.int32)
        for w in range(_MAP):
            bits += np.bitwise_count(maps[x, w][:, None] & maps[right, w][None, :])
        a, b = n[x][:, None].astype(np.int64), n[right][None, :].astype(np.int64)
        need = np.where(np.maximum(a, b) <= MAPPED, (a + b) * (p / (1 + p)) - 1e-9, MAPPED * p - 5 * (MAPPED * p * (1 - p)) ** 0.5)
        good = (a * 100 >= b * percent) & (b * 100 >= a * percent) & (root[x][:, None] != root[right][None, :])
        good &= bits + np.minimum(lost[x][:, None], lost[right][None, :]) >= need
        i, k = np.nonzero(good)
        xs.append(x[i])
        ys.append(right[k])
    return np.concatenate(xs), np.concatenate(ys)


def _listed_pairs(percent: int):
    """From members of lists, in blocks (v, i, j) of two parts of a list, the pairs a > b that may reach the threshold;
    a pair counts in the least of the lists that both are in."""

    def done(v: int, i: int, j: int, group: pa.Table) -> pa.RecordBatch | None:
        col = lambda c: group.column(c).combine_chunks()
        node, root, n, part = (col(c).to_numpy() for c in ("node", "root", "n", "part"))
        maps = np.frombuffer(b"".join(x.as_buffer() for x in col("map")), np.uint64).reshape(len(node), _MAP)
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        x, y = _pairs_of(node, root, n, maps, left, right, percent)
        if i == j:
            once = node[x] > node[y]
            x, y = x[once], y[once]
        if not len(x):
            return None
        lists, every = {}, col("every")
        for k in np.unique(np.concatenate([x, y])).tolist():
            lists[k] = frozenset(every[k].values.to_numpy().tolist())
        own = np.array([min(lists[a] & lists[b]) == v for a, b in zip(x.tolist(), y.tolist())], bool)
        x, y = x[own], y[own]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[x], node[y])), pa.array(np.minimum(node[x], node[y]))], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groups_of(batches, ("v", "i", "j")):
            if (out := done(*key, group)) is not None:
                yield out

    return rows


def _run(percent: int) -> int:
    """Retained values in a list's key: as many as pairs at the threshold have in a row almost surely."""
    return 3 if percent >= 80 else 2 if percent >= 65 else 1


def _lists(nodes: DataFrame, percent: int, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """v, node, n, weight: the inverted lists, by runs of values, that more than one node is in, the sizes of nodes, and
    how long the lists of a node are together. Of lists with the same members one is kept, by count and 128 bits of
    hash, as copies share runs all along their sketches; it counts as long as all of them.
    """
    held = F.size("sketch")

    def runs(length: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), held - length), lambda i: F.xxhash64(F.lit(length), F.slice("sketch", i + 1, length)))
        return F.when((held >= length) & ((F.lit(length) == _run(percent)) | (held <= FEW)), each).otherwise(F.array().cast("array<long>"))

    listed = nodes.select("node", F.explode(F.array_distinct(F.concat(*map(runs, range(1, _run(percent) + 1))))).alias("v"))
    # sums are stored before they are joined, so that Spark can split the hot keys of what they are joined with
    common = own(listed.groupBy("v").agg(F.count("*").alias("many")).where("many > 1"))
    kept = own(listed.join(common, "v").select("v", "node"))
    members = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"members{i}") for i in (1, 2)]
    alike = kept.groupBy("v").agg(F.count("*").alias("many"), *members).groupBy("many", "members1", "members2")
    one_of_each = own(alike.agg(F.min("v").alias("v"), (F.col("many") * F.count("*")).alias("long")).select("v", "long"))
    kept = own(kept.join(one_of_each, "v").select("v", "node", "long"))
    weights = own(kept.groupBy("node").agg(F.sum("long").alias("weight")).join(nodes.select("node", "n"), "node"))
    return own(kept.join(weights, "node").select("v", "node", "n", "weight"))


def _families(pairs: DataFrame, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """k1, k2, a, b: the pairs of a family of candidates, in blocks of two parts of it of about BLOCK members."""
    pairs = own(pairs)
    found = components(pairs)
    roots = own(found)
    forget(found)
    parts = own(roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    placed = own(roots.join(parts, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    a, b = (placed.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("part").alias(f"part_{c}")) for c in ("a", "b"))
    low, high = F.least("part_a", "part_b"), F.greatest("part_a", "part_b")
    return pairs.join(a, "a").join(b, "b").select(F.col("root_a").alias("k1"), (low.cast("long") * (1 << 31) + high).alias("k2"), "a", "b")


def _links(nodes: DataFrame, lists: DataFrame, texts: DataFrame, size: int, percent: int, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs a > b of nodes at the threshold that join all nodes which chains of such pairs join."""
    found: list[DataFrame] = []
    roots, before = None, None
    for turn in range(ROUNDS + 1):
        tagged = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots, "node", "left").select("v", "node", "n", "weight", F.coalesce("root", "node").alias("root"))
        # first the member that stands in the longest lists; then any of the largest class
        rank = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
        groups = tagged.groupBy("v", "root").agg(F.count("*").alias("c"), F.max(F.struct(rank.alias("rank"), "node", "n")).alias("one"))
        most = F.max(F.struct((F.col("c") if turn else F.col("one.rank")).alias("by"), F.col("one.node").alias("node"), "root", F.col("one.n").alias("n")))
        groups = groups.groupBy("v").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), most.alias("most"))
        apart = own(groups.where("m * m > q").select("v", "m", F.col("most.root").alias("pivot_root"), F.col("most.node").alias("pivot"), F.col("most.n").alias("pivot_n"), (F.col("m") * F.col("m") - F.col("q")).alias("cross")))
        cross, rows = apart.agg(F.coalesce(F.sum("cross"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if not cross:
            break
        members = tagged.join(apart, "v")
        # pivots go on while they are of use
        last = turn == ROUNDS or turn > 0 and (cross <= LISTED * rows or cross > 0.8 * before)
        before = cross
        if last:
            members = own(members.select("v", "node", "root", F.ceil(F.col("m") / LISTED).cast("int").alias("parts")))
            every = own(members.groupBy("node").agg(F.collect_list("v").alias("every")))
            every = own(every.join(with_chance(nodes, ["node"], every.select("node"), "_chance").where("_chance").drop("_chance"), "node"))
            placed = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            placed = placed.select("v", "node", "root", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
            blocks = placed.join(every, "node").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
            keyed = _families(blocks.mapInArrow(_listed_pairs(percent), "a long, b long"), own)
        else:
            # sets of other sizes than the threshold allows need no comparison
            sized = F.least("n", "pivot_n").cast("long") * 100 >= F.greatest("n", "pivot_n").cast("long") * percent
            pairs = members.where((F.col("root") != F.col("pivot_root")) & sized).groupBy("pivot", "node").agg(F.max("m").alias("m"))
            part = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK))
            keyed = pairs.select(F.col("pivot").alias("k1"), part.alias("k2"), F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"))
        found.append(own(_similar(own(keyed), texts, size, percent)))
        if last:
            break
        forget(roots)
        links = found[0]
        for more in found[1:]:
            links = links.union(more)
        roots = components(links)
    if not found:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    # what rounds before the last have joined is in roots
    links = found[-1] if roots is None else found[-1].union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = own(links)
    forget(roots)
    return links


def _classes(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """id, a, b, n, component and kept of each row of docs, stored; see near_duplicates."""
    a, b = row_keys(key, text)
    keyed = in_small_batches(docs).select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), a.alias("_a"), b.alias("_b"))
    with tables() as own:
        rows = own(keyed.mapInArrow(_sketches(shingle, "_text", "_id", K), _SKETCHED))
        full = rows.where("n > 0 and id is not null")
        # documents of one set are one node, named by its least key; the few that a repeated key would confuse, by hash
        nodes = own(full.groupBy("same1", "same2").agg(F.min(F.struct("id", "a", "b", "n", "sketch", "map")).alias("one")).select("same1", "same2", "one.*"))
        several = nodes.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("again"))
        named = F.when(F.col("again").isNull(), F.col("id")).otherwise(F.xxhash64("id", "same1", "same2"))
        nodes = nodes.join(own(several), F.col("id") == F.col("again"), "left").withColumn("node", named).drop("again")
        lists = _lists(nodes, percent, own)
        listed = own(nodes.select("node", "a", "b").join(lists.select("node").distinct(), "node", "left_semi"))
        # texts of nodes in no list are not shuffled
        wanted = with_chance(keyed, ["_a", "_b"], listed.select("a", "b"), "_chance").where("_chance").join(listed, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).select("_a", "_b", "node", F.col("_text").alias("text"))
        # bucketed by node, so that joins with it move the other side only
        with bucketed(wanted.dropDuplicates(["_a", "_b"]).select("node", "text"), "node") as texts:
            links = _links(nodes.select("node", "n", "map"), lists, texts, shingle, percent, own)
        roots = components(links)
        classes = own(nodes.join(roots, "node", "left").select("same1", "same2", "id", F.coalesce("root", "node").alias("root")))
        forget(roots)
        least = own(classes.groupBy("root").agg(F.min("id").alias("least")))
        classes = own(classes.join(least, "root").select("same1", "same2", "least"))
        own_class = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
        out = rows.join(classes, ["same1", "same2"], "left")
        return cut(out.select("id", "a", "b", "n", own_class.alias("component"), (F.col("id").isNull() | (own_class == F.col("id"))).alias("kept")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: the key, near_shingles (distinct shingles of `shingle` words; fewer words make one,
    none make none), near_component (the least key that chains of links reach, its own included) and near_kept.

    Two documents are linked where 100 * intersection >= percent * union of their shingles, lower-cased in A-Z. Texts
    without words (null, empty) are linked with nothing. Rows of equal key and text fare alike; rows of equal key with
    other texts are documents of their own. A row whose key is null is linked with nothing, has no component and is
    kept. Texts of any length are compared whole. Other columns of docs, whatever their names, play no part and are not
    returned. An empty table gives an empty one.
    """
    found = _classes(docs, key, text, shingle, percent)
    return found.select(F.col("id").alias(key), F.col("n").cast("long").alias("near_shingles"), F.col("component").alias("near_component"), F.col("kept").alias("near_kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Of each class of near-duplicates the rows with the least key, in all their columns, whatever their names; see
    near_duplicates, also for nulls, empty and long texts, ties, repeated rows and empty tables."""
    found = _classes(docs, key, text, shingle, percent)
    gone = cut(found.where("not kept").select("a", "b").distinct())
    forget(found)
    plain, names = anonymous(docs)
    a, b = row_keys(names[key], names[text])
    # rows that surely stay are not shuffled
    plain = with_chance(plain.withColumn("_a", a).withColumn("_b", b), ["_a", "_b"], gone, "_chance")
    rest = plain.where("_chance").join(gone.toDF("_ka", "_kb"), (F.col("_a") == F.col("_ka")) & (F.col("_b") == F.col("_kb")), "left_anti")
    return plain.where("not _chance").union(rest).select(*names.values()).toDF(*docs.columns)
