"""Whole texts as arrays of words, and hashes of words and of runs of words, a block at a time.

A block is some Arrow rows of one task (about `BLOCK_BYTES` of text, one row at least), so that memory follows the
block and not the partition. Null texts are empty texts. A word's hash sums mixes of its 8-byte pieces with their places;
a run's hash is mixed from the hashes of its two halves. Both go through a non-linear step at every stage, so words or
runs of a regular structure collide no more often than others. Equal input gives equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

#: For each kind of hash a seed and two odd multipliers.
_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (8, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first n bytes of a piece.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Separators of words: white space, or every ASCII byte but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which near values come to lie far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a block: row i of it has words first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def last(self) -> np.ndarray:
        """For each word, the end of its row's words."""
        return np.repeat(self.first[1:], self.counts())

    def _pieces(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The 8-byte pieces of some words: where each word's begin, the word and the place of each, and its bytes."""
        length = self.ends[which] - self.starts[which]
        count = (length + 7) >> 3
        begin = np.cumsum(count) - count
        of = np.repeat(np.arange(len(which)), count)
        place = np.arange(len(of)) - begin[of]
        wide = np.ndarray(len(self.data) - 7, np.dtype("<u8"), buffer=self.data, strides=(1,))
        return begin, of, place, wide[self.starts[which][of] + 8 * place] & _FIRST[np.minimum(length[of] - 8 * place, 8)]

    def hashes(self, kind: int = 0) -> np.ndarray:
        seed, once, twice = _SEEDS[kind]
        if not len(self):
            return np.zeros(0, np.uint64)
        begin, _, place, piece = self._pieces(np.arange(len(self)))
        each = mixed((piece ^ seed) + (place + 1).astype(np.uint64) * once)
        return mixed(np.add.reduceat(each, begin) + (self.ends - self.starts).astype(np.uint64) * twice)

    def numbers(self) -> np.ndarray:
        """A number for each word; two words of the block have the same if and only if they are equal, byte by byte."""
        _, first, which = np.unique(self.hashes(), return_index=True, return_inverse=True)
        like = first[which]
        other = np.flatnonzero(like != np.arange(len(self)))
        length = self.ends - self.starts
        same = bool((length[other] == length[like[other]]).all()) and bool((self._pieces(other)[3] == self._pieces(like[other])[3]).all())
        if same:
            return which.astype(np.int64)
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.word(i), len(known)) for i in range(len(self))], np.int64)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: list, separators: np.ndarray, lower: bool = False) -> Words:
    """texts: buffers of UTF-8. A word is a longest run of bytes that are no separators; 0x20 must be one."""
    data = np.frombuffer(b" ".join([b"", *texts, b" " * 8]), np.uint8)
    if lower:
        data = _LOWER[data]
    edges = np.flatnonzero(np.diff(separators[data].view(np.int8))) + 1
    starts, ends = edges[::2], edges[1::2]
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(data, starts, ends, np.searchsorted(starts, at))


def buffers_of(column: pa.Array) -> list:
    """The UTF-8 of each row, null as empty, without copies."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    if column.null_count:
        valid = column.is_valid().to_pylist()
        return [data[at[i] : at[i + 1]] if valid[i] else data[:0] for i in range(len(column))]
    return [data[at[i] : at[i + 1]] for i in range(len(column))]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The rows of a task in blocks of about `limit` bytes of text, each with its texts' UTF-8."""
    for batch in batches:
        texts, begin, held = buffers_of(batch.column(batch.schema.get_field_index(text))), 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(t) + 1
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def runs(values: np.ndarray, size: int, kind: int = 1) -> np.ndarray:
    """Hashes of all runs of `size` values, that from place i at i; none if there are fewer values."""
    n, (seed, once, _) = len(values) - size + 1, _SEEDS[kind]
    if n <= 0:
        return np.zeros(0, np.uint64)
    held, have = mixed(values ^ seed), 1
    while 2 * have <= size:
        held, have = mixed(held[:-have] * once + held[have:]), 2 * have
    return held if have == size else mixed(held[:n] * once + held[size - have : size - have + n])


def sums(values: np.ndarray, at: np.ndarray, kind: int = 3) -> np.ndarray:
    """A hash of each stretch values[at[i] : at[i + 1]], whatever its order."""
    seed, once, _ = _SEEDS[kind]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed((values ^ seed) * once), out=total[1:])
    return mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def _shingles(words: Words, size: int, whole: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and where each row's begin: of `whole` (a value for each run of `size`
    words), and of rows of fewer words the one of `short`."""
    counts = words.counts()
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), each)
    base = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(each, out=base[1:])
    found = np.empty(len(row), whole.dtype)
    full = counts[row] >= size
    found[full] = whole[(words.first[row] + np.arange(len(row)) - base[row])[full]]
    found[~full] = short[row[~full]]
    for begin, end in zip(base[:-1].tolist(), base[1:].tolist()):
        found[begin:end].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(counts) + 1))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row as sorted hashes, and where each row's begin. A row of fewer words than
    `size` has the whole sequence as its one shingle, a row without words none."""
    hashes, counts = words.hashes(), words.counts()
    short = np.zeros(len(counts), np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        short[r] = runs(hashes[words.first[r] : words.first[r + 1]], int(counts[r]), 4)[0]
    return _shingles(words, size, runs(hashes, size, 2), short)


def exact_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets(), with numbers in place of hashes: within the block two are the same if and only if the
    shingles are, word by word."""
    own, counts = words.numbers(), words.counts()
    short, known = np.zeros(len(counts), np.int64), {}
    for r in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        short[r] = -1 - known.setdefault(tuple(own[words.first[r] : words.first[r + 1]].tolist()), len(known))
    held, have, n = own, 1, max(len(own) - size + 1, 0)
    while n and have < size:
        step = min(have, size - have)
        left, right = held[: len(held) - step], held[step:]
        held = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    return _shingles(words, size, held[:n], short)
