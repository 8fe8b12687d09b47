"""What several operators need of Spark: cut lineage, keys of rows, running totals, classes of links."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; its session from now on hands rows to Python in batches of BATCH_BYTES or less, so that the memory of
    executors and workers doesn't follow the length of texts."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    given = conf.get(name)
    if not given.isdigit() or int(given) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """A new name under the checkpoint folder that the cluster shares, for tables that a query writes and reads again.
    The folder is taken from spark.checkpoint.dir. Only where driver and executors are one process, as in tests, a new
    local one may stand in, with a warning; elsewhere an unset folder raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="postora-")
            warnings.warn(f"spark.checkpoint.dir is unset; tables are stored in {folder}", stacklevel=2)
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: lost executors cost no earlier work, what is read again is
    not computed again, and plans of loops stay small."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes what cut() wrote for frames that nothing will read again."""
    for df in frames:
        if df is not None and getattr(df, "_folder", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A cut() whose tables are deleted in the end: what outlives them must be cut outside."""
    held: list[DataFrame] = []

    def own(df: DataFrame) -> DataFrame:
        held.append(cut(df))
        return held[-1]

    try:
        yield own
    finally:
        forget(*held)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df as a table of the warehouse, in as many buckets by key as shuffles have partitions, a file each; it is dropped
    in the end."""
    spark, name = df.sparkSession, f"postora_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def free(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def anonymous(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1 and so on, which no name of an operator's own is like, and the new name of each."""
    names = {n: f"c{i}" for i, n in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def row_keys(id_column: str, text_column: str) -> tuple[Column, Column]:
    """Two longs, never null, of the id (null apart from any other) and the whole text with its length: the id itself,
    where it is a number, which takes little room in a shuffle, and 64 bits of hash; else 128 bits of hash. Rows alike
    in both have the same keys."""
    own = [F.col(id_column).isNull(), F.col(id_column), F.coalesce(F.octet_length(F.col(text_column)), F.lit(-1)), F.col(text_column)]
    return F.coalesce(F.col(id_column).cast("string").try_cast("long"), F.xxhash64(F.lit(1), *own)), F.xxhash64(F.lit(2), *reversed(own))


#: Words of 64 bits that a filter of keys has at most, 8 MB of them, and keys of which it would hold back too little.
_FILTER_WORDS, _FILTERED_KEYS = 1 << 20, 1 << 24


def with_chance(df: DataFrame, own: Sequence[str], keys: DataFrame, out: str) -> DataFrame:
    """df with `out`, which is false only where the longs `own` of a row, never null, are in no row of keys (stored, as
    many longs), so that a join with keys need not shuffle such rows.

    Each key sets three bits of one word of a filter, which is broadcast and never beyond _FILTER_WORDS; other rows pass
    by chance, some hundredths of them at 2**22 keys. Beyond _FILTERED_KEYS keys `out` is true for all rows.
    """
    n = keys.count()
    if n > _FILTERED_KEYS:
        return df.withColumn(out, F.lit(True))
    words = min(_FILTER_WORDS, 1 << max(10, (n // 4).bit_length()))

    def spot(*key: str) -> tuple[Column, Column]:
        drawn = F.xxhash64(F.lit(3), *key)
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(drawn, at).bitwiseAND(63).cast("int")) for at in (40, 46, 52)]
        return drawn.bitwiseAND(F.lit(words - 1).cast("long")), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    word, bits = spot(*keys.columns)
    held = keys.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    word, bits = spot(*own)
    passed = F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False))
    return df.join(F.broadcast(held), word == F.col("_word"), "left").select(*df.columns, passed.alias(out))


def celled(df: DataFrame, group: str, order: str, cell: str, digits: int = 3) -> DataFrame:
    """df with `cell`, a string that is never null: the group, dealt into 16**digits parts by the first digits of
    `order`, a hexadecimal string. Cells of a group sort as its rows do by `order`."""
    return df.withColumn(cell, F.concat(F.substring(order, 1, digits), F.lit("|"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))))


def with_running_total(df: DataFrame, cells: DataFrame, group: str, cell: str, order: list[str], amount: Column, out: str, more: Sequence[str] = ()) -> DataFrame:
    """Adds `out`, the sum of `amount` over the rows of the same group that come before, and the columns `more` of the
    row's cell. df is celled(); cells has group, cell and s, the sum of a cell's amounts.

    Sums of cells are added up in a window of at most a group's cells, and each cell is ordered by itself, so that no
    task gets a whole group; window and join share one exchange by cell. Rows alike in all of `order` come in any order.
    """
    earlier = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col(cell).alias("of"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"), *more)
    inside = Window.partitionBy(cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return ranked.join(offsets, F.col(cell) == F.col("of")).withColumn(out, F.col(out) + F.col("offset")).drop("of", "offset", cell)


def with_sums_before(df: DataFrame, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """df, stored in the given order, with for each name the sum of its amount over all rows before. Rows lie in ranges
    of the order, a task each; only the ranges' sums come to the driver."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sums = placed.groupBy(part.alias("p")).agg(*[F.sum(a).alias(n) for n, a in amounts.items()]).orderBy("p").collect()  # a row for each range
    before, total = [], dict.fromkeys(amounts, 0)
    for r in sums:
        before.append((r["p"], *total.values()))
        total = {n: v + (r[n] or 0) for n, v in total.items()}
    offsets = df.sparkSession.createDataFrame(before, ", ".join(["p long", *(f"`{n}_offset` long" for n in amounts)]))
    inside = Window.partitionBy("p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.withColumn("p", part).join(F.broadcast(offsets), "p")
    return joined.select(*df.columns, *[(F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"{n}_offset")).alias(n) for n, a in amounts.items()])


#: Links that are joined at once.
_HELD_LINKS = 1 << 20
#: Links, 4 MB of them, that one task joins to the end once no more are left.
_LAST_LINKS = 1 << 18


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, sorted, and the least node that links reach from each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        after, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while not (after == after[after]).all():
            after = after[after]
        if (after == root).all():
            return nodes, nodes[root]
        root = after


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task with those of each _HELD_LINKS turned into stars."""
    held, rows = [], 0

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, roots = least_reached(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        apart = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= _HELD_LINKS:
            yield stars(held)
            held, rows = [], 0
    if held:
        yield stars(held)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each node of at most _LAST_LINKS links, roots included."""
    held = [x for x in batches if x.num_rows]
    if held:
        nodes, roots = least_reached(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges: longs a and b. Returns node and root, the smallest node that links reach, for each node of a link; the
    frame can be forgotten like one that was cut.

    Each task joins what links it has; then large-star and small-star steps in turn, each of which moves links toward
    smaller nodes, until all links are stars or so few are left, by count, that one task joins them. Nothing but a count
    and a test comes to the driver. Least neighbours are summed up before they are shuffled and stored, so that the
    joins with them read two plain exchanges, whose hot keys Spark can split.
    """
    contracted = lambda df: cut(df.select("a", "b").mapInArrow(_contracted, "a long, b long"))
    links = contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        if links.count() <= _LAST_LINKS:
            out = cut(links.coalesce(1).mapInArrow(_joined, "node long, root long"))
            forget(links)
            return out
        # stars: each node has one link downward, and none that is linked to has any
        ends = links.select(F.col("a").alias("k"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("b", F.lit(0), F.lit(1)))
        seen = ends.groupBy("k").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if seen.where("down > 1 or down > 0 and up > 0").limit(1).count() == 0:
            out = links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out._folder = links._folder
            return out
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m")))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"))
        joined = large.join(low, F.col("a") == F.col("k"))
        after = contracted(joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        forget(links, least, low)
        links = after


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal keys."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in keys], 1)
        at = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(at, at[1:]):
            if now is not None and now != tuple(own[begin].tolist()):
                yield now, pa.Table.from_batches(held)
                held = []
            now = tuple(own[begin].tolist())
            held.append(batch.slice(begin, end - begin))
    if held:
        yield now, pa.Table.from_batches(held)
