"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by sign flips and fast Hadamard transforms, three of each; its hash is the axis, with its sign, that
it then lies nearest to. A table joins some such hashes to a bucket; a vector also stands in the buckets in which one
hash is its second nearest axis. The more vectors, the more hashes a table joins, so that buckets don't grow; how many
tables find a pair just at the threshold is measured on drawn pairs before.

What is dealt by bucket are numbers of vectors. Members of a bucket are compared with its least one, then, where that
leaves several families in a bucket, all members of different ones, and last all members of a family with each other,
so that each link is counted once. Vectors are fetched for these comparisons by block, and pairs never leave a task:
it returns the least vector that links reach, or how many links each has. Equal vectors are one, with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postora.llm import text as tx
from postora.llm.frames import components, cut, forget, groups_of, in_small_batches, least_reached, tables

#: The share of pairs just at the threshold that may share no bucket.
MISSED = 0.001
#: Hashes of a table at least and at most, and tables at most.
LEAST_TURNS, MOST_TURNS, MOST_TABLES = 2, 8, 64
#: Vectors of a block: compared with one, and compared among themselves.
BLOCK, SQUARE = 128, 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def _axes(x: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest signed axis of each turned vector."""
    drawn = np.random.Generator(np.random.PCG64([20240301, turn, x.shape[1]]))
    for _ in range(3):
        x = _hadamard(x * (drawn.integers(0, 2, x.shape[1]) * 2 - 1))
    size = np.abs(x)
    each = np.arange(len(x))
    first = size.argmax(1)
    size[each, first] = -1
    second = size.argmax(1)
    return tuple(2 * a + (x[each, a] < 0) for a in (first, second))


def buckets(vectors: np.ndarray, tables: int, turns: int) -> np.ndarray:
    """For each unit vector and table a row of buckets: its own, and those with the second axis in one of the hashes."""
    wide = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    padded = np.zeros((len(vectors), wide))
    padded[:, : vectors.shape[1]] = vectors
    out = np.zeros((len(vectors), tables, 1 + turns), np.uint64)
    for t in range(tables):
        out[:, t] = tx.mixed(np.array([vectors.shape[1] * MOST_TABLES + t], np.uint64))
        for i in range(turns):
            first, second = (tx.mixed((a * MOST_TURNS + i + 1).astype(np.uint64)) for a in _axes(padded, MOST_TURNS * t + i))
            out[:, t, 1 + i] += second
            for k in range(1 + turns):
                if k != 1 + i:
                    out[:, t, k] += first
    return tx.mixed(out).view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


@cache
def planned(vectors: int, dimensions: int, least: float) -> tuple[int, int]:
    """Tables and hashes of each for so many vectors: as many hashes as leave a bucket about one vector by chance, and
    as many tables as find all but MISSED of drawn pairs whose cosine is `least`."""
    axes = 2 << max(0, int(dimensions - 1).bit_length())
    turns = min(MOST_TURNS, max(LEAST_TURNS, math.ceil(math.log(max(vectors, 2)) / math.log(axes))))
    if dimensions == 1:
        return 1, turns
    drawn = np.random.Generator(np.random.PCG64([20240302, dimensions, turns]))
    x, z = (unit(drawn.normal(size=(500, dimensions))) for _ in range(2))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    near = least * x + math.sqrt(max(0.0, 1 - least * least)) * z
    bx, by = buckets(x, 4, turns), buckets(near, 4, turns)
    found = (bx[:, :, :, None] == by[:, :, None, :]).any((2, 3)).mean()
    return min(MOST_TABLES, math.ceil(math.log(MISSED) / math.log(max(1 - found, 1e-9))) + 1 if found else MOST_TABLES), turns


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of one length, from a list column without nulls."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1))


def _standing(plans: dict[int, tuple[int, int]]):
    """node and bucket of each place where a vector stands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, held = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.asarray(held.value_lengths())
            for n in np.unique(lengths).tolist():
                which = np.flatnonzero(lengths == n)
                for i in range(0, len(which), 2048):
                    at = which[i : i + 2048]
                    found = buckets(_matrix(held.take(pa.array(at))), *plans[n]).reshape(len(at), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[at], found.shape[1])), pa.array(found.ravel())], names=["node", "bucket"])

    return rows


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _with_pivot(least: float):
    """Of blocks k1, k2 the members that are linked with node k1, itself among them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _), group in groups_of(batches, ("k1", "k2")):
            node, vectors = group.column("node").to_numpy(), _matrix(group.column("vector"))
            linked = node[(vectors @ vectors[np.flatnonzero(node == pivot)[0]] >= least) & (node != pivot)]
            if len(linked):
                yield _pairs(linked, np.full(len(linked), pivot))

    return rows


def _square(group: pa.Table, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the two parts of a block, and which of those are linked."""
    part, vectors = group.column("part").to_numpy(), _matrix(group.column("vector"))
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    linked = vectors[left] @ vectors[right].T >= least
    if i == j:
        np.fill_diagonal(linked, False)
    return left, right, linked


def _across(least: float):
    """Of blocks k, i, j links that join what members of different roots link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in groups_of(batches, ("k", "i", "j")):
            left, right, linked = _square(group, i, j, least)
            node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
            x, y = np.nonzero(linked & (root[left][:, None] != root[right][None, :]))
            if len(x):
                yield _pairs(*least_reached(node[left[x]], node[right[y]]))

    return rows


def _counted(least: float):
    """Of blocks k, i, j the number of links of each member, copies of the linked ones counted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in groups_of(batches, ("k", "i", "j")):
            left, right, linked = _square(group, i, j, least)
            node, many = group.column("node").to_numpy(), group.column("many").to_numpy()
            links = np.zeros(len(node), np.int64)
            links[left] += linked @ many[right]
            if i != j:
                links[right] += many[left] @ linked
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    return rows


def _squares(members: DataFrame, size: str, vectors: DataFrame) -> DataFrame:
    """members (k, node and more) with their vectors, in blocks k, i, j of two parts of each k; `size` is its number of
    members."""
    parts = F.ceil(F.col(size) / SQUARE).cast("int")
    placed = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))
    return placed.drop("parts", "o", size).join(vectors, "node").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """A row for each row of vectors: the key, near_links (other vectors whose cosine in double precision reaches
    `least`), near_component (the least key that chains of links reach, its own included) and near_kept.

    Vectors that are null, empty or zero or hold null or non-finite components, and those whose key is null, are
    linked with nothing and kept; a null key has no component. Vectors of other lengths are never linked. Rows of
    equal key are vectors of their own; equal vectors are linked with each other. Vectors may have any length. Other
    columns, whatever their names, play no part and are not returned. An empty table gives an empty one.
    """
    kind = vectors.schema[embedding].dataType
    held = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    rows = in_small_batches(vectors).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast(held).alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    sound = F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.coalesce(fine, F.lit(False))
    with tables() as own:
        # equal vectors are one node, named by its least key; those that a repeated key would confuse, by a hash
        nodes = own(rows.where(sound).groupBy("e").agg(F.min("id").alias("id"), F.count("*").alias("many")))
        several = own(nodes.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("again")))
        named = F.when(F.col("again").isNull(), F.col("id")).otherwise(F.xxhash64("id", "e"))
        nodes = own(nodes.join(several, F.col("id") == F.col("again"), "left").select(named.alias("node"), "id", "many", "e"))
        fetched = nodes.select("node", "many", F.col("e").alias("vector"))
        plans = {r["d"]: planned(r["n"], r["d"], least) for r in nodes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length
        standing = own(nodes.select("node", "e").mapInArrow(_standing(plans), "node long, bucket long"))
        # sums are stored before they are joined, so that Spark can split the hot keys of what they are joined with
        heads = standing.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1")
        placed = own(standing.join(own(heads), "bucket"))
        pairs = placed.where("node <> pivot").groupBy("pivot", "node").agg(F.max("m").alias("m"))
        blocks = own(pairs.select(F.col("pivot").alias("k1"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)).cast("int").alias("k2"), "node"))
        blocks = blocks.union(blocks.select("k1", "k2", F.col("k1").alias("node")).distinct())
        linked = blocks.join(fetched.drop("many"), "node").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
        links = own(linked.mapInArrow(_with_pivot(least), "a long, b long"))
        roots = components(links)
        tagged = placed.join(roots, "node", "left").select(F.col("bucket").alias("k"), "node", F.coalesce("root", "node").alias("root"))
        groups = tagged.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum("c").alias("m"), F.count("*").alias("roots"))
        apart = own(groups.where("m > 2 and roots > 1").select("k", "m"))
        across = _squares(tagged.join(apart, "k"), "m", fetched.drop("many")).mapInArrow(_across(least), "a long, b long")
        links = own(links.union(across))
        forget(roots)
        found = components(links)
        roots = own(found)
        forget(found)
        families = own(roots.groupBy("root").agg(F.count("*").alias("m")).withColumnRenamed("root", "k"))
        members = roots.withColumnRenamed("root", "k").join(families, "k")
        counts = _squares(members, "m", fetched).mapInArrow(_counted(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
        counts = own(counts)
        classes = own(nodes.join(counts, "node", "left").join(roots, "node", "left").select("e", "id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("root", "node").alias("root")))
        least_key = own(classes.groupBy("root").agg(F.min("id").alias("least")))
        classes = own(classes.join(least_key, "root").select("e", "links", "least"))
        out = rows.withColumn("sound", sound).join(classes.withColumnRenamed("e", "v"), F.col("sound") & (F.col("e") == F.col("v")), "left")
        own_class = F.coalesce("least", "id")
        return cut(out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("near_links"), own_class.alias("near_component"), (F.col("id").isNull() | (own_class == F.col("id"))).alias("near_kept")))
