"""Mixing sources to target weights by a curriculum that varies over training.

Each source has a target of tokens and a schedule, the density at which training asks for it at each time from 0 to 1.
The integral of the schedule, scaled to the target, is the source's cumulative demand; a document, whose tokens lie at
a known place in its source's stream, gets the time at which demand reaches its middle. Documents in order of that
time are the training order. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postora.llm.frames import anonymous, celled, cut, free, with_running_total, with_sums_before

WEIGHTS = (5, 2, 1)
#: For each of the weights, knots (time, density) between which density is linear: heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.25), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sums: a row for each source, with source and source_size. Adds kind (the source's place in `weights`) and target.

    Sources in order of code points, null last, take the weights in turn. The targets share the sum of all sizes by
    weight; one that exceeds `most` times its source's size stops there, and the excess goes to the others by weight,
    until none exceeds: in order of what a unit of weight may take at most, sources stop up to the first that the rest
    of the words, shared among it and those after it, doesn't fill. Sums of ranges of sources and two rows come to the
    driver. Without any size, targets are 0.
    """
    ranked = with_sums_before(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    kinds = ranked.withColumn("kind", (F.col("rank") % len(weights)).cast("int")).drop("rank")
    kinds = kinds.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("kind") + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    # what a unit of weight may take, in whole numbers
    kinds = kinds.withColumn("fill", F.col("cap") * (F.lit(math.lcm(*map(int, weights))) / F.col("weight")).cast("long"))
    order = [F.col("fill"), F.col("source").asc_nulls_last()]
    filled = with_sums_before(kinds, order, {"place": F.lit(1), "full": F.col("cap"), "above": F.col("weight")})
    total, weight = kinds.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, share = F.lit(total) - F.col("full"), F.lit(weight) - F.col("above")
    level = filled.where(left * F.col("weight") <= F.col("cap") * share).agg(F.min_by(F.struct(left.alias("left"), share.alias("share")), "place").alias("l")).first()["l"]
    left, share = (level["left"], level["share"]) if level and total else (0, 1)
    above = F.col("cap") * F.lit(share) < F.lit(left) * F.col("weight")
    even = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(share))
    return kinds.select("source", "kind", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(even).alias("target"))


def _area(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """For each stretch between knots: the share of all area before it, its start, length and densities, scaled to a
    total area of 1."""
    total = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        out.append((before, t0, t1 - t0, a / total, b / total))
        before += (t1 - t0) * (a + b) / 2 / total
    return out


def _inverted(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral reaches `share` of its whole."""
    found, after = None, 1.0
    for before, start, length, a, b in reversed(_area(knots)):
        y = F.greatest(share - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + y * (2 * (b - a) / length), F.lit(0.0)))
        at = F.least(F.lit(start) + 2 * y / F.nullif(root + a, F.lit(0.0)), F.lit(start + length))
        at = F.coalesce(at, F.lit(start))
        found = at if found is None else F.when(share < F.lit(after), at).otherwise(found)
        after = before
    return found


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, most: int = MOST_REPEATS) -> DataFrame:
    """All rows and columns of docs, with mix_size, mix_source_size, mix_target, mix_takes (how often the mix takes
    the document, 0 to `most`) and mix_positions (times in training, from 0 to 1, one for each take).

    A source's stream is its documents in an order drawn from their keys, over and over. The mix takes those of the
    stream whose middle lies before the target, so the words taken miss the target by half a document at most.
    Null texts and texts without words have size 0 and are taken only where the target is above their place; texts of
    any length count whole; a null source is a source. Equal keys are ordered by size and text; equal rows are taken in
    any order among themselves. Columns of any name pass through; where docs has a column of a result's name, that
    result, the last of its kind in the returned columns, has underscores before its own. An empty table gives an empty
    one.
    """
    outs = ("size", "source_size", "target", "takes", "positions")
    named = [*docs.columns, *(free(f"mix_{n}", docs.columns) for n in outs)]
    docs, names = anonymous(docs)
    source, text, key = names[source], names[text], names[key]
    c = {n: f"mix_{n}" for n in (*outs, "order", "content", "before", "kind", "cell")}
    sized = docs.withColumn(c["size"], size_of(text)).withColumn(c["order"], F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn(c["content"], F.xxhash64(text))
    sized = celled(sized, source, c["order"], c["cell"])
    cells = cut(sized.groupBy(c["cell"], source).agg(F.sum(c["size"]).alias("s")))
    aims = targets(cells.groupBy(F.col(source).alias("source")).agg(F.sum("s").cast("long").alias("source_size")), weights, most)
    aims = cut(aims).select(F.col("source").alias("aim_source"), F.col("kind").alias(c["kind"]), F.col("source_size").alias(c["source_size"]), F.col("target").alias(c["target"]))
    # what a cell's rows need to know of their source comes with the cell
    cells = cells.join(aims, F.col(source).eqNullSafe(F.col("aim_source"))).drop("aim_source")
    placed = with_running_total(sized, cells, source, c["cell"], [c["order"], key, c["size"], c["content"]], F.col(c["size"]), c["before"], [c["kind"], c["source_size"], c["target"]])
    middles = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: p * F.col(c["source_size"]) + F.col(c["before"]) + F.col(c["size"]) / 2)
    taken = F.filter(middles, lambda m: m < F.col(c["target"]))
    timed = lambda knots: lambda m: _inverted(m / F.col(c["target"]), knots)
    times = None
    for i, knots in enumerate(schedules):
        own = F.transform(taken, timed(knots))
        times = F.when(F.col(c["kind"]) % len(schedules) == i, own) if times is None else times.when(F.col(c["kind"]) % len(schedules) == i, own)
    out = placed.withColumn(c["positions"], times)
    return out.withColumn(c["takes"], F.size(c["positions"]).cast("long")).select(*docs.columns, *[c[n] for n in outs]).toDF(*named)


def in_training_order(mixed: DataFrame, partitions: int | None = None, positions: str = "mix_positions") -> DataFrame:
    """A row for each take of each document, range-partitioned and sorted by its position.

    `positions` is the column of times; its place is taken by the time of the row, in mix_position or, where there is
    such a column, that name with underscores before it, always the last column. Rows whose times are null or none are
    left out; other columns of any name pass through; equal times come in any order. An empty table gives an empty one.
    """
    plain, names = anonymous(mixed)
    others = [c for c in mixed.columns if c != positions]
    spread = plain.withColumn("at", F.explode(names[positions])).select(*[names[c] for c in others], "at")
    dealt = spread.repartitionByRange(partitions, "at") if partitions else spread.repartitionByRange("at")
    return dealt.sortWithinPartitions("at").toDF(*others, free("mix_position", others))
