"""Removal of passages that occur elsewhere, found by difference-cover anchors.

Of a document's positions only those whose place modulo a period lies in a difference cover are anchored: a hash of
the `size - period + 1` words from there. For any two places there is a shift below the period that brings both into
the cover, so two equal windows of `size` words hold equal anchors at the same shift. Anchors that occur once are
dropped. Those left are extended: the windows of `size` words that hold one are hashed (88 bits of two hashes of their
words, neither of which a regular structure of words can bring to collide), and windows whose hash occurs again are the
repeats. Among 10**12 windows two that differ share a hash at a chance of about one in 600. Anchors, which only say
where to look, have 48 bits.

Occurrences are counted in each map task before they are shuffled, a block at a time: what a block holds twice needs
no answer, and only one row of it is sent, so that a passage in a third of all documents costs a row a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postora.llm import text as tx
from postora.llm.frames import anonymous, free, in_small_batches, row_keys

#: Occurrences a task holds before it counts and sends them.
HELD = 1 << 20
#: A row has the hash h of what stands at a place, the keys a and b of its document, and x: 24 bits of a second hash,
#: then the place. Without keys it says how many places of a block hold the same, their number in x. With _KNOWN in x
#: the place is known to repeat. In this order and in the order of documents, rows take the least room in a shuffle.
_SENT = "h long, x long, a long, b long"
_KNOWN, _LOW = 1 << 31, (1 << 32) - 1
_ANCHOR = np.uint64((1 << 48) - 1)


def difference_cover(period: int) -> list[int]:
    """Places below the period such that every difference modulo the period occurs between two of them: the smallest
    such set for short periods, else one of about twice the root of the period."""
    covers = lambda s: len({(x - y) % period for x in s for y in s}) == period
    root = max(1, math.isqrt(period - 1))
    if period <= 31:
        for n in range(1, period + 1):
            if n * (n - 1) + 1 >= period:
                for rest in combinations(range(1, period), n - 1):
                    if covers((0, *rest)):
                        return [0, *rest]
    step = root + 1
    return sorted({*range(step), *range(0, period, step), period - 1})


def _period(size: int) -> int:
    """About three fifths of the window, so that few positions are anchored and anchors keep most of a passage."""
    return max(1, min(size, round(size * 0.6)))


def _counted(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT for the occurrences h, g, a, b, pos of some blocks."""
    h, g, a, b, pos = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h))).astype(np.int32)
    n = np.empty(len(h), np.int32)
    n[order] = np.repeat(count, count)
    # rows stay in the order of documents, in which they take the least room; known places go by their document
    several, once, known = order[at[count > 1]], n == 1, n > 1
    by_row = tx.mixed(a[known].view(np.uint64) ^ b[known].view(np.uint64))
    second, place = g.astype(np.int64) << 32, pos.astype(np.int64)
    none = np.arange(len(h) + len(several)) - int(once.sum())
    none = (none >= 0) & (none < len(several))
    columns = (
        pa.array(np.concatenate([h[once], h[several], by_row]).view(np.int64)),
        pa.array(np.concatenate([second[once] | place[once], second[several] | n[several], place[known] | _KNOWN])),
        *(pa.array(np.concatenate([k[once], k[several], k[known]]), mask=none) for k in (a, b)),
    )
    batch = pa.RecordBatch.from_arrays(list(columns), names=["h", "x", "a", "b"])
    for i in range(0, batch.num_rows, 1 << 16):
        yield batch.slice(i, 1 << 16)


def _gathered(each: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, found = 0, []
    for rows in each:
        if len(rows[0]):
            found.append(rows)
            held += len(rows[0])
        if held >= HELD:
            yield from _counted(found)
            held, found = 0, []
    if found:
        yield from _counted(found)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("_a", "_b"))


def _anchors(size: int, text: str):
    period = _period(size)
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    length = size - period + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch, texts in tx.blocks(batches, text):
            words = tx.words_of(texts, tx.WHITE)
            row, (a, b) = words.row_of(), _keys(batch)
            place = np.arange(len(words)) - words.first[row]
            starts = np.flatnonzero(cover[place % period] & (place + length <= words.counts()[row]) & (words.counts()[row] >= size))
            h = tx.runs(words.hashes(), length)[starts] & _ANCHOR
            row = row[starts]
            yield h, np.zeros(len(h), np.uint32), a[row], b[row], place[starts].astype(np.int32)

    return lambda batches: _gathered(rows(batches))


def _extended(size: int, text: str):
    period = _period(size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch, texts in tx.blocks(batches, text):
            words = tx.words_of(texts, tx.WHITE)
            hits, (a, b) = batch.column(batch.schema.get_field_index("_hits")), _keys(batch)
            count = np.asarray(hits.value_lengths())
            row = np.repeat(np.arange(len(texts)), count)
            anchor = hits.flatten().to_numpy(zero_copy_only=False) + words.first[row]
            low, high = np.maximum(anchor - period + 1, words.first[row]), np.minimum(anchor, words.first[row + 1] - size)
            good = low <= high
            marks = np.zeros(len(words) + 1, np.int32)
            np.add.at(marks, low[good], 1)
            np.add.at(marks, high[good] + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            row = words.row_of()[starts]
            h, g = tx.runs(words.hashes(), size, 3)[starts], (tx.runs(words.hashes(4), size, 5)[starts] >> np.uint64(40)).astype(np.uint32)
            yield h, g, a[row], b[row], (starts - words.first[row]).astype(np.int32)

    return lambda batches: _gathered(rows(batches))


def _places(sent: DataFrame) -> DataFrame:
    """The rows' keys and the places in them that occur again anywhere."""
    x, low = F.col("x"), F.col("x").bitwiseAND(F.lit(_LOW))
    known = low >= _KNOWN
    number = F.when(F.col("a").isNull(), low).when(known, 0).otherwise(1)
    # dealt by h alone, so that what follows from x isn't shuffled
    dealt = sent.repartition("h").withColumn("g", F.shiftright(x, 32))
    total = dealt.withColumn("total", F.sum(number).over(Window.partitionBy("h", "g")))
    again = total.where(F.col("a").isNotNull() & (known | (F.col("total") > 1)))
    return again.groupBy(F.col("a").alias("_ka"), F.col("b").alias("_kb")).agg(F.collect_set(low.bitwiseAND(F.lit(_KNOWN - 1)).cast("int")).alias("_hits"))


def _without(size: int, text: str, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.blocks(batches, text):
            hits = batch.column(batch.schema.get_field_index("_hits")).to_pylist()
            out, n_words, n_removed = [], [], []
            for t, starts in zip(texts, hits):
                words = bytes(t).split()
                gone = 0
                n_words.append(len(words))
                if starts:
                    marks = np.zeros(len(words) + 1, np.int32)
                    marks[starts] = 1  # a set of places
                    np.add.at(marks, np.asarray(starts) + size, -1)
                    keep = np.cumsum(marks[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = compress(words, keep.tolist())
                out.append(b" ".join(words))
                n_removed.append(gone)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).view(pa.string())], names=[*names, "words", "removed", "kept"])

    return rows


def remove_repeats(docs: DataFrame, size: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs, with repeat_words (words of the text), repeat_removed (those covered by a window
    of `size` words whose sequence also starts anywhere else, the same document included) and repeat_kept (the other
    words, joined by one space). Windows are judged on the texts as they came.

    Words are runs of what is not ASCII white space. Null and empty texts have no words; texts of fewer than `size`
    words lose none; texts of any length are judged whole, a task holding the words of one at a time. Rows alike in key
    and text are copies of each other and lose every window; null keys are ordinary keys. Columns of any name pass
    through; where docs has a column of a result's name, that result has underscores before its own. An empty table
    gives an empty one.
    """
    outs = [free(f"repeat_{n}", docs.columns) for n in ("words", "removed", "kept")]
    plain, names = anonymous(in_small_batches(docs))
    a, b = row_keys(names[key], names[text])
    keyed = plain.withColumn("_a", a).withColumn("_b", b)
    anchored = keyed.select("_a", "_b", names[text]).mapInArrow(_anchors(size, names[text]), _SENT)
    places = _places(anchored)
    on = lambda p: [F.col("_a") == p["_ka"], F.col("_b") == p["_kb"]]
    extended = keyed.join(places, on(places)).mapInArrow(_extended(size, names[text]), _SENT)
    repeats = _places(extended)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields]
    schema = ", ".join([*fields, "words long", "removed long", "kept string"])
    found = keyed.join(repeats, on(repeats), "left").mapInArrow(_without(size, names[text], plain.columns), schema)
    return found.toDF(*docs.columns, *outs)
