"""A key-value store as an append-only log of entries (schema.ENTRY), read by newest entry."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postora.sources.tables import delete, files_under, numbered

# The value that marks a deleted key, and when files are merged.
TOMBSTONE = b"bitcask_tombstone"
SMALL_FILE, SMALL_FILES, LEAST_LIVE = 1000, 5, 0.4
LONGEST_KEY = 65535


def crc(key: Column, value: Column, tstamp: Column) -> Column:
    """CRC-32 of an entry: timestamp, lengths, key, value."""
    wide = lambda n, digits: F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(digits)))
    return F.crc32(F.concat(wide(tstamp, 8), wide(F.octet_length(key), 4), wide(F.octet_length(value), 8), key, value))


def entries(rows: DataFrame, key: str, value: str, tstamp: str, order: Sequence[str], per_file: int = 100_000, first_file: int = 1) -> DataFrame:
    """Rows as log entries in the given order; a file ends after per_file entries. A key of more than LONGEST_KEY bytes
    raises once it is read."""
    short = F.octet_length(F.col(key).cast("string")) <= LONGEST_KEY
    rows = rows.where(F.when(short | F.col(key).isNull(), True).otherwise(F.raise_error(F.lit("a key is too long")).cast("boolean")))
    placed = numbered(rows.select(F.col(key).cast("string").cast("binary").alias("key"), F.col(value).cast("string").cast("binary").alias("value"), F.col(tstamp).cast("int").alias("tstamp"), *order), list(order), "place", 0)
    return placed.select("key", "value", "tstamp", (F.floor(F.col("place") / per_file) + first_file).cast("int").alias("file_id"), (F.col("place") % per_file).alias("offset"), crc(F.col("key"), F.col("value"), F.col("tstamp")).alias("crc"))


def put(log: str, new: DataFrame) -> None:
    """Appends entries to a log, a folder for each of its files."""
    new.write.mode("append").partitionBy("file_id").parquet(log)


def checked(log: DataFrame) -> DataFrame:
    """The log; an entry that isn't what its checksum says raises once it is read."""
    good = F.col("crc") == crc(F.col("key"), F.col("value"), F.col("tstamp"))
    return log.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad checksum in file "), F.col("file_id").cast("string"))).cast("boolean")))


def newest(log: DataFrame) -> DataFrame:
    """The newest entry of each key, by timestamp, file and offset."""
    rank = F.struct("tstamp", "file_id", "offset")
    return log.groupBy("key").agg(F.max_by(F.struct("value", "tstamp", "file_id", "offset", "crc"), rank).alias("e")).select("key", "e.*")


def visible(log: DataFrame, now: int | None = None, expiry_secs: int = 0) -> DataFrame:
    """Newest entries that are neither deleted nor older than expiry_secs (0: never too old)."""
    found = newest(log).where(F.col("value") != F.lit(TOMBSTONE))
    return found.where(F.col("tstamp") >= now - expiry_secs) if expiry_secs and now is not None else found


def get(log: DataFrame, *keys: bytes, now: int | None = None, expiry_secs: int = 0) -> DataFrame:
    """Values of some keys; the filter on keys reaches the scan."""
    return visible(log.where(F.col("key").isin(*keys)), now, expiry_secs).select("key", "value")


def fold(log: DataFrame, *aggregates: Column, by: Sequence[Column] = (), now: int | None = None, expiry_secs: int = 0) -> DataFrame:
    """Aggregates over visible entries, in all or by group. An accumulator of the caller's own is an aggregate too, built
    in or a UDF of theirs."""
    return visible(log, now, expiry_secs).groupBy(*by).agg(*aggregates)


def fold_keys(log: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over the keys of the newest entries, without reading values."""
    return log.groupBy("key").agg(F.max(F.struct("tstamp", "file_id", "offset")).alias("e")).select("key", "e.*").agg(*aggregates)


def live_ratio(log: DataFrame) -> DataFrame:
    """file_id, total, live and ratio: entries of each file, and those that are the newest of their key.

    The newest place of a key is found by a sum that shuffles a row a key and task, and joined back."""
    last = log.groupBy("key").agg(F.max(F.struct("tstamp", "file_id", "offset")).alias("e"))
    now_live = last.groupBy(F.col("e.file_id").alias("f")).agg(F.count("*").alias("live"))
    totals = log.groupBy("file_id").agg(F.count("*").alias("total"))
    joined = totals.join(now_live, totals["file_id"] == now_live["f"], "left")
    return joined.select("file_id", "total", F.coalesce("live", F.lit(0)).alias("live"), (F.coalesce("live", F.lit(0)) / F.col("total")).alias("ratio"))


def merge_plan(log: DataFrame, writing: int | None = None) -> DataFrame:
    """file_id and action of each file but the one that is written: drop where nothing lives; compact files of few
    entries once there are enough; merge where little lives; else keep."""
    ratios = live_ratio(log)
    ratios = ratios if writing is None else ratios.where(F.col("file_id") != writing)
    small = (F.col("live") > 0) & (F.col("total") < SMALL_FILE)
    enough = F.lit(ratios.where(small).count() >= SMALL_FILES)
    action = F.when(F.col("live") == 0, "drop").when(small, F.when(enough, "compact").otherwise("keep")).when(F.col("ratio") < LEAST_LIVE, "merge").otherwise("keep")
    return ratios.select("file_id", "total", "live", action.alias("action"))


def merged(log: DataFrame, now: int | None = None, expiry_secs: int = 0, files: int | None = None) -> DataFrame:
    """The log with one entry a key: newest ones, without deleted and expired ones. What is visible stays the same."""
    out = visible(log, now, expiry_secs).select("key", "value", "tstamp", "file_id", "offset", "crc")
    return out.coalesce(files) if files else out


def merge_files(spark: SparkSession, log: str, writing: int | None = None) -> dict[str, list[int]]:
    """Executes the merge plan of a stored log, file by file: those without live entries are deleted; of those to be
    compacted or merged, live entries go to one new file. Files that are kept aren't rewritten. Returns the files of
    each action.

    A mark of deletion stays as long as a file that is kept has older entries of its key. The new file is written before
    the old ones go: what is visible is the same all the while, also if the run is cut short.
    """
    every = spark.read.parquet(log)
    done: dict[str, list[int]] = {"drop": [], "compact": [], "merge": [], "keep": []}
    for r in merge_plan(every, writing).orderBy("file_id").collect():  # a row for each file
        done[r["action"]].append(r["file_id"])
    old = done["compact"] + done["merge"]
    if old:
        own, others = every.where(F.col("file_id").isin(old)), every.where(~F.col("file_id").isin(old + done["drop"]))
        last = every.groupBy("key").agg(F.max(F.struct("tstamp", "file_id", "offset")).alias("e")).select(F.col("key").alias("k"), "e.*").where(F.col("file_id").isin(old))
        live = own.alias("o").join(last.alias("l"), (F.col("key") == F.col("k")) & F.expr("o.tstamp = l.tstamp and o.file_id = l.file_id and o.offset = l.offset")).select("o.*")
        gone = F.col("value") == F.lit(TOMBSTONE)
        kept = live.where(~gone).unionByName(live.where(gone).join(others.select("key").distinct(), "key", "left_semi"))
        new = max([writing or 0, *old, *done["drop"], *done["keep"]]) + 1
        columns = [F.col("key").cast("string").alias("k"), "key", "value", "tstamp", "crc"]
        placed = numbered(kept.select(*columns), ["k"], "offset", 0).withColumn("file_id", F.lit(new))
        put(log, placed.select("key", "value", "tstamp", "file_id", "offset", "crc"))
    for f in old + done["drop"]:
        delete(spark, f"{log}/file_id={f}")
    return done


def stats(log: DataFrame, *folders: str) -> DataFrame:
    """keys, entries and bytes of keys and values; with folders, also the number and bytes of the files under them."""
    size = F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0))
    found = [files_under(log.sparkSession, f) for f in folders]
    disk = [F.lit(sum(f[0] for f in found)).alias("files"), F.lit(sum(f[1] for f in found)).alias("disk_bytes")] if folders else []
    return log.agg(F.count_distinct("key").alias("keys"), F.count("*").alias("entries"), size.alias("bytes"), *disk)


class Cached:
    """The newest values of at most `size` keys, those asked for last, in the driver's memory. Keys that aren't held are
    read in one job; that a key has no value is held as well."""

    def __init__(self, log: DataFrame, size: int = 250_000) -> None:
        self.log, self.size = log, size
        self.held: OrderedDict[bytes, bytes | None] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, *keys: bytes) -> DataFrame:
        """key and value of those that have one."""
        missing = [k for k in dict.fromkeys(keys) if k not in self.held]
        self.hits, self.misses = self.hits + len(keys) - len(missing), self.misses + len(missing)
        found = {k: self.held[k] for k in keys if k in self.held}
        if missing:
            read = {bytes(r["key"]): bytes(r["value"]) for r in get(self.log, *missing).collect()}  # a row for each key asked for
            found |= {k: read.get(k) for k in missing}
        for k in keys:
            self.held[k] = found[k]
            self.held.move_to_end(k)
        self.resize(self.size)
        return self.log.sparkSession.createDataFrame([(k, v) for k, v in found.items() if v is not None], "key binary, value binary")

    def resize(self, size: int) -> None:
        self.size = size
        while len(self.held) > size:
            self.held.popitem(last=False)
            self.evictions += 1

    def clear(self) -> None:
        self.held.clear()
