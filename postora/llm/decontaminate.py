"""Benchmark passages in documents.

For each length of an item, windows of that many words slide over a document. A window's fingerprints are SimHashes of
its shingles, weighted by how often they occur; each is looked up in a multi-index: its 64 bits are cut into 4 blocks,
and items stand under every block value within 3 bits of theirs, so that every item within a radius of 15 bits is
found. What is found is verified on the shingles themselves: the sum of lesser counts against the sum of greater ones.

Three independent fingerprints are looked up, since one alone lies beyond the radius for one in forty windows just at a
similarity of 0.8; all three do for about one in 70,000. Windows that hold no shingle of any item of their length have
similarity 0 and are not fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postora.llm import text as tx
from postora.llm.frames import free, in_small_batches

PRINTS, BLOCKS, WIDTH, NEAR = 3, 4, 16, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Items that one pass over the documents looks for; more items take more passes.
ITEMS = 2000
_FOUND = "array<struct<item: long, similarity: double, start: long, words: long>>"
_MASKS = np.array([sum(1 << i for i in bits) for n in range(NEAR + 1) for bits in combinations(range(WIDTH), n)], np.uint32)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """Votes of -1 or 1 of each shingle for each bit of all fingerprints."""
    each = np.stack([tx.mixed(shingles + np.uint64(7919 * (i + 1))) for i in range(PRINTS)], 1)
    ones = np.unpackbits(each.view(np.uint8).reshape(len(shingles), -1), axis=1, bitorder="little")
    return ones.astype(np.int32) * 2 - 1


def _prints(votes: np.ndarray) -> np.ndarray:
    """Fingerprints, a row of PRINTS words for each row of votes; a tie counts as 0."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).reshape(len(votes), PRINTS)


@dataclass
class Index:
    """Items of one pass, by their fingerprints and shingles."""

    ids: list[int]
    shingle: int
    counts: list[dict[int, int]] = field(default_factory=list)
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def build(self, texts: list[bytes]) -> Index:
        words = tx.words_of(texts, tx.WHITE, lower=True)
        hashes, n = words.hashes(), words.counts()
        self.lengths, votes, known = n, [], {}
        for i, (at, count) in enumerate(zip(words.first[:-1], n)):
            g = min(self.shingle, count)
            found = tx.runs(hashes[at : at + count], g, 2) if count else np.zeros(0, np.uint64)
            self.counts.append(dict(zip(*(x.tolist() for x in np.unique(found, return_counts=True)))))
            votes.append(_bits(found).sum(0) if count else np.zeros(64 * PRINTS, np.int32))
            if count:
                known.setdefault((int(g), int(count)), []).append(found)
        self.prints = _prints(np.array(votes).reshape(len(texts), 64 * PRINTS))
        #: By size of shingle and length of item, the items' shingles, sorted.
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.gates = {}
        for g in {k[0] for k in self.known}:
            gate = np.zeros(1 << 20, bool)
            for k, v in self.known.items():
                if k[0] == g:
                    gate[v >> np.uint64(44)] = True
            self.gates[g] = gate
        self.tables = []
        items = np.flatnonzero(n > 0)
        for p in range(PRINTS):
            for b in range(BLOCKS):
                own = (self.prints[items, p] >> np.uint64(b * WIDTH)).astype(np.uint32) & np.uint32((1 << WIDTH) - 1)
                value = (own[:, None] ^ _MASKS[None, :]).ravel()
                order = np.argsort(value, kind="stable")
                self.tables.append((np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)), np.repeat(items, len(_MASKS))[order].astype(np.int32)))
        return self

    def within(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of this length that have a fingerprint within the radius of each other."""
        window, item = [], []
        for p in range(PRINTS):
            for b in range(BLOCKS):
                begin, members = self.tables[p * BLOCKS + b]
                value = (prints[:, p] >> np.uint64(b * WIDTH)).astype(np.int64) & ((1 << WIDTH) - 1)
                n = begin[value + 1] - begin[value]
                w = np.repeat(np.arange(len(prints)), n)
                i = members[np.repeat(begin[value] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                near = (self.lengths[i] == length) & (np.bitwise_count(prints[w, p] ^ self.prints[i, p]) <= RADIUS)
                window.append(w[near])
                item.append(i[near])
        pairs = np.unique(np.concatenate(window) * len(self.ids) + np.concatenate(item))
        return pairs // len(self.ids), pairs % len(self.ids)


def weighted_similarity(x: dict[int, int], y: dict[int, int]) -> float:
    both = sum(min(n, y.get(k, 0)) for k, n in x.items())
    union = sum(x.values()) + sum(y.values()) - both
    return both / union if union else 0.0


def _searched(index: Index, least: float, words: tx.Words) -> dict[int, dict[int, tuple[float, int, int]]]:
    """By row and item, the similarity, start and length of the row's best window, the first of equals."""
    hashes, counts, found = words.hashes(), words.counts(), {}
    for g, gate in index.gates.items():
        # the shingle from each word, also over the ends of texts, where none counts
        shingles = tx.runs(hashes, g, 2)
        at = np.flatnonzero((np.arange(len(shingles)) + g <= words.last()[: len(shingles)]) & gate[shingles >> np.uint64(44)])
        value = shingles[at]
        if not len(at):
            continue
        for (own, length), known in index.known.items():
            if own != g:
                continue
            hit = at[known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value]
            if not len(hit):
                continue
            row = np.searchsorted(words.first, hit, "right") - 1
            fits = np.minimum(length, counts[row])
            low = np.maximum(hit + g - fits, words.first[row])
            high = np.minimum(hit, words.first[row + 1] - fits)
            n = high - low + 1
            window = np.unique(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
            row = np.searchsorted(words.first, window, "right") - 1
            fits = np.minimum(length, counts[row])
            inside = fits - g + 1
            for i in range(0, len(window), 2048):
                _verify(index, least, shingles, window[i : i + 2048], row[i : i + 2048], inside[i : i + 2048], words, g, length, found)
    return found


def _verify(index: Index, least: float, every: np.ndarray, window: np.ndarray, row: np.ndarray, inside: np.ndarray, words: tx.Words, g: int, length: int, found: dict) -> None:
    # the windows overlap: votes are summed once over all their shingles
    places = np.unique(np.repeat(window - np.cumsum(inside) + inside, inside) + np.arange(inside.sum()))
    shingles = every[places]
    sums = np.zeros((len(places) + 1, 64 * PRINTS), np.int32)
    np.cumsum(_bits(shingles), axis=0, out=sums[1:])
    begin = np.searchsorted(places, window)
    end = begin + inside
    w, item = index.within(_prints(sums[end] - sums[begin]), length)
    held: dict[int, dict[int, int]] = {}
    for k, i in zip(w.tolist(), item.tolist()):
        if k not in held:
            value, count = np.unique(shingles[begin[k] : end[k]], return_counts=True)
            held[k] = dict(zip(value.tolist(), count.tolist()))
        similarity = weighted_similarity(held[k], index.counts[i])
        if similarity >= least:
            best, r = found.setdefault(int(row[k]), {}), int(row[k])
            if i not in best or best[i][0] < similarity:
                best[i] = (similarity, int(window[k] - words.first[r]), int(inside[k]) + g - 1)


def _rows(index: Index, least: float, text: str, columns: list[str], out: str):
    kind = pa.list_(pa.struct([("item", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.blocks(batches, text):
            found = _searched(index, least, tx.words_of(texts, tx.WHITE, lower=True))
            hits = [[{"item": index.ids[i], "similarity": s, "start": at, "words": n} for i, (s, at, n) in sorted(found.get(r, {}).items())] for r in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(hits, kind)], names=[*columns, out])

    return rows


def leaks(docs: DataFrame, items: DataFrame, key: str = "item_id", item_text: str = "text", text: str = "text", shingle: int = 5, least: float = 0.8, columns: list[str] | None = None) -> DataFrame:
    """All rows of docs with their columns (or those named) and leak_found: for each item that a window of its length
    (or the whole text, if shorter) reaches the similarity of, the item's id, the best similarity, and the window's
    first word and number of words.

    Words are runs of what is not ASCII white space, lower-cased in A-Z; fewer words than a shingle make one. Items
    and texts that are null or without words match nothing. Texts and items of any length count whole. Items of equal
    id or text are items of their own; of equally similar windows the first counts; repeated rows of docs fare alike.
    Other columns pass through; where docs has a column leak_found, the result's has underscores before it. Without
    items nothing is found; without documents the result is empty. Items are looked for in passes of ITEMS over the
    documents, so that no task holds more of them.
    """
    columns = docs.columns if columns is None else columns
    out, passed = free("leak_found", docs.columns), []
    held: list[tuple[int | None, bytes]] = []

    def searched(frame: DataFrame, held: list) -> DataFrame:
        index = Index([i for i, _ in held], shingle).build([t for _, t in held])
        name = free("leak_found", frame.columns)
        kept = [*frame.columns]
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
        passed.append(name)
        return frame.mapInArrow(_rows(index, least, text, kept, name), ", ".join([*fields, f"`{name}` {_FOUND}"]))

    rows = items.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).orderBy("k", "t").toLocalIterator()
    frame = in_small_batches(docs).select(*dict.fromkeys([*columns, text]))
    for r in rows:
        held.append((r["k"], r["t"].encode()))
        if len(held) == ITEMS:
            frame, held = searched(frame, held), []
    if held or not passed:
        frame = searched(frame, held)
    every = F.concat(*passed) if len(passed) > 1 else F.col(passed[0])
    return frame.select(*columns, every.alias(out))
