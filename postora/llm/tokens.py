"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

Texts are cut into pre-tokens: runs of what is not white space, each after a mark of a word's begin. A pre-token's best
segmentation has the greatest sum of its pieces' scores; bytes that no piece covers stand alone at a low score. The
distinct pre-tokens of a block are inserted in a trie, and the best score of each prefix is computed once for all
pre-tokens that share it, a depth of the trie at a time; where a pre-token ends, the trie has its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postora.llm import text as tx
from postora.llm.frames import free, in_small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Pre-tokens of more bytes are cut by themselves, not in the trie.
SHALLOW = 64
#: Counts of pre-tokens that a task remembers.
REMEMBERED = 1 << 20


class Vocabulary:
    """Scores of pieces, and a trie of them. The file's pieces are ranked, not weighed: a piece of rank r is scored as the
    r-th word of a Zipf distribution, -log(r + 2). A byte without a piece of its own costs `alone`."""

    def __init__(self, pieces: list[bytes], alone: float | None = None) -> None:
        self.score = {p: -float(np.log(r + 2)) for r, p in reversed(list(enumerate(pieces))) if p}
        self.alone = alone if alone is not None else -float(np.log(len(pieces) + 2)) - 10
        #: From a node of the trie (0: its root) and a byte, as node * 256 + byte, to the next node.
        self.after: dict[int, int] = {}
        ends = [-np.inf]
        for piece, score in self.score.items():
            node = 0
            for byte in piece:
                step = node << 8 | byte
                if step not in self.after:
                    self.after[step] = len(ends)
                    ends.append(-np.inf)
                node = self.after[step]
            ends[node] = score
        #: By node, the score of the piece that ends there, -inf if none does.
        self.ends = np.array(ends)
        self._steps = np.array(sorted(self.after), np.int64)
        self._next = np.array([self.after[s] for s in self._steps.tolist()], np.int64)

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return Vocabulary([model.id_to_piece(i).encode() for i in plain])

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where no piece goes on so."""
        steps = nodes << 8 | bytes_
        if not len(self._steps):
            return np.full(len(steps), -1)
        at = np.minimum(np.searchsorted(self._steps, steps), len(self._steps) - 1)
        return np.where(self._steps[at] == steps, self._next[at], -1)

    def tokens(self, word: bytes) -> int:
        """Pieces of the best segmentation of a word, of equal scores the fewest."""
        best, count, begun = 0.0, 0, []
        for byte in word:
            begun.append((0, best, count))
            best, count, going = best + self.alone, count + 1, []
            for node, score, tokens in begun:
                node = self.after.get(node << 8 | byte)
                if node is not None:
                    going.append((node, score, tokens))
                    value = score + self.ends[node]
                    if value > best or value == best and tokens + 1 < count:
                        best, count = value, tokens + 1
            begun = going
        return count


def trie_counts(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each word; words are sorted and distinct.

    At each depth a node of the words' trie has its best score and count, and the pieces that have begun above it and
    may yet end below: each a node of the vocabulary's trie with the score and count of where it began.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    length = np.array([len(w) for w in words])
    deep = int(length.max())
    grid = np.zeros((n, deep + 1), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(n), length)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    # node[i] at a depth: the prefix of word live[i]
    live, node = np.arange(n), np.zeros(n, np.int64)
    best, count = np.zeros(1), np.zeros(1, np.int64)
    # pieces begun, by the node they stand at
    at, piece, score, tokens = (np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
    for depth in range(1, deep + 1):
        longer = length[live] >= depth
        live, node = live[longer], node[longer]
        byte = grid[live, depth - 1].astype(np.int64)
        new = np.ones(len(live), bool)
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        parent, byte = node[new], byte[new]
        at, piece = np.concatenate([at, np.arange(len(best))]), np.concatenate([piece, np.zeros(len(best), np.int64)])
        score, tokens = np.concatenate([score, best]), np.concatenate([tokens, count])
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(len(best) + 1))
        many = (begin[1:] - begin[:-1])[parent]
        own = np.repeat(np.arange(len(parent)), many)
        which = order[np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + begin[parent][own]]
        after = vocabulary.step(piece[which], byte[own])
        going = after >= 0
        at, piece, score, tokens = own[going], after[going], score[which[going]], tokens[which[going]]
        ending = np.isfinite(vocabulary.ends[piece])
        to = np.concatenate([np.arange(len(parent)), at[ending]])
        value = np.concatenate([best[parent] + vocabulary.alone, score[ending] + vocabulary.ends[piece[ending]]])
        number = np.concatenate([count[parent], tokens[ending]]) + 1
        order = np.lexsort((number, -value, to))
        first = order[np.searchsorted(to[order], np.arange(len(parent)))]
        best, count = value[first], number[first]
        node = np.cumsum(new) - 1
        ends = length[live] == depth
        out[live[ends]] = count[node[ends]]
    return out


@cache
def _loaded(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def _rows(path: str, text: str, columns: list[str], out: str):
    kind = pa.struct([("tokens", pa.int64()), ("words", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(path)
        known, counted = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch, texts in tx.blocks(batches, text):
            words = tx.words_of(texts, tx.WHITE)
            hashes = words.hashes()
            distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            seen = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
            n = np.zeros(len(distinct), np.int64)
            n[seen] = counted[at[seen]]
            fresh = np.flatnonzero(~seen)
            spelled = [MARK + words.word(i) for i in first[fresh].tolist()]
            order = sorted((i for i, w in enumerate(spelled) if len(w) <= SHALLOW), key=spelled.__getitem__)
            n[fresh[order]] = trie_counts([spelled[i] for i in order], vocabulary)
            for i, w in enumerate(spelled):
                if len(w) > SHALLOW:
                    n[fresh[i]] = vocabulary.tokens(w)
            if len(known) + len(fresh) > REMEMBERED:
                known, counted = known[:0], counted[:0]
            merged = np.concatenate([known, distinct[fresh]])
            order = np.argsort(merged)
            known, counted = merged[order], np.concatenate([counted, n[fresh]])[order]
            sums = np.zeros(len(words) + 1, np.int64)
            np.cumsum(n[which], out=sums[1:])
            total = pa.StructArray.from_arrays([pa.array(sums[words.first[1:]] - sums[words.first[:-1]]), pa.array(words.counts().astype(np.int64))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), total], names=[*columns, out])

    return rows


def count(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """All rows of docs with their columns (or those named) and token_count: tokens of the whole text and its words.
    `vocabulary` is the path of a sentencepiece model, the same on every executor.

    Null and empty texts have no tokens. Texts of any length are cut whole; a word of very many bytes is cut byte by
    byte. Of segmentations of equal score that with the fewest tokens counts. Rows are judged one by one, so repeated
    rows fare alike. Where docs has a column token_count, the result's has underscores before it. An empty table gives
    an empty one.
    """
    columns = docs.columns if columns is None else columns
    needed = in_small_batches(docs).select(*dict.fromkeys([*columns, text]))
    out, names = free("token_count", docs.columns), [c for c in needed.columns if c in columns]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema.fields if f.name in columns]
    return needed.mapInArrow(_rows(vocabulary, text, names, out), ", ".join([*fields, f"`{out}` struct<tokens: long, words: long>"]))
