"""A quality classifier of supervised subword embeddings.

Words, byte n-grams (white space counted as one kind of blank) and words said again shortly after are hashed into
buckets, each with a learned vector; a document is the average of the vectors of all its occurrences, and a softmax over two classes gives the
chance of label 1. Vectors and softmax are trained together by stochastic gradient descent in numpy, on the driver,
over a sample of labelled rows whose bound is a parameter. Since the average and the two-class softmax are linear up to
the logistic, scoring needs a number for each bucket alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postora.llm import text as tx
from postora.llm.frames import free, in_small_batches

BITS, DIM, GRAMS = 17, 8, (2, 3, 4)
#: A word that also stands so many words before has a feature for that.
LAGS = (1, 2, 3, 4)
#: Occurrences without a vector that every average takes in, so that a few words alone decide nothing.
SMOOTH = 40
#: At most so many labelled rows are trained on; of more, those least by a hash of their key.
MOST_ROWS = 4000
EPOCHS, RATE, SEED = 6, 20.0, 20240401

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[tx.WHITE] = 0x20


def _features(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket of each occurrence in a block, and where each text's begin and end."""
    words = tx.words_of(texts, tx.WHITE)
    shift = np.uint64(64 - BITS)
    hashes, row = words.hashes(6), words.row_of()
    yield (hashes >> shift).astype(np.int32), words.first[:-1], words.first[1:]
    for lag in LAGS:
        again = np.flatnonzero((hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])) + lag
        yield np.full(len(again), lag, np.int32), np.searchsorted(again, words.first[:-1]), np.searchsorted(again, words.first[1:])
    data = _BLANK[words.data]
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(length + 1) - length
    code = data.astype(np.uint32)
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
        if n in GRAMS:
            # a gram takes in the blanks that join texts at its edges only by a text's own byte before and after
            at = ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            yield at.astype(np.int32), np.minimum(begin, len(at)), np.minimum(np.maximum(begin, begin + length - n + 1), len(at))


@dataclass
class Model:
    """Vectors of buckets, and weights and biases of the two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Of each bucket the difference of the classes' logits, and the difference of the biases."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def occurrences(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features, and the share of each in all occurrences."""
    found = np.concatenate([ids[a[0] : b[0]] for ids, a, b in _features([text])])
    ids, count = np.unique(found, return_counts=True)
    return ids.astype(np.int32), (count / (len(found) + SMOOTH)).astype(np.float32)


def _features_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in tx.blocks(batches, "t"):
        found = [occurrences(bytes(t)) for t in texts]
        packed = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("h", "k", "label_value")), *packed], names=["h", "k", "label", "ids", "share"])


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent on the cross-entropy, a document a step, at a rate that falls to zero."""
    drawn = np.random.Generator(np.random.PCG64(SEED))
    vectors = drawn.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if len(labels):
        rate = np.clip(labels.mean(), 1 / (len(labels) + 1), len(labels) / (len(labels) + 1))
        bias[:] = np.log([1 - rate, rate])
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for i in drawn.permutation(len(documents)).tolist():
            ids, share = documents[i]
            step = RATE * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            hidden = share @ vectors[ids]
            logits = weights @ hidden + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            back = weights.T @ chance
            weights -= (step * 0.05) * np.outer(chance, hidden)
            bias -= 0.01 * chance
            vectors[ids] -= (step * share)[:, None] * back
    return Model(vectors, weights, bias)


def in_holdout(key: str) -> Column:
    """Rows that are never trained on: those whose key, as text, has a CRC-32 that is 2 modulo 4. A null key is ''."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model of the labelled rows outside the hold-out, of at most `most_rows`. A key with several labels counts
    with the least; labels other than 0 and 1, and null keys, are left out. Texts of any length are learned from whole;
    null ones are empty. Repeated rows of docs count as often as they come, within the bound. Columns besides key, text
    and label play no part. Without any label, as of empty tables, a model of even odds."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~in_holdout(key)).groupBy(F.col(key).alias("label_key")).agg(F.min(label).cast("int").alias("label_value"))
    sample = known.orderBy(F.xxhash64("label_key"), "label_key").limit(most_rows)
    chosen = in_small_batches(docs).select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(sample), F.col("k") == F.col("label_key"))
    counted = chosen.select(F.xxhash64("k", "t").alias("h"), F.col("k").cast("string").alias("k"), "t", "label_value").mapInArrow(_features_of_rows, "h long, k string, label int, ids binary, share binary")
    # what a repeated key adds is bounded as well; a row has at most a number and a share for each bucket
    rows = counted.orderBy("h", "k").limit(most_rows).select("ids", "share", "label").collect()
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows], np.array([r["label"] for r in rows], np.int64))


def _scored(model: Model, text: str, columns: list[str], out: str):
    table, bias = model.folded()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.blocks(batches, text):
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for ids, begin, end in _features(texts):
                sums = np.zeros(len(ids) + 1)
                np.cumsum(table[ids], out=sums[1:])
                total += sums[end] - sums[begin]
                count += end - begin
            score = 1 / (1 + np.exp(-np.clip(total / (count + SMOOTH) + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(score)], names=[*columns, out])

    return rows


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """All rows of docs with their columns (or those named) and quality_score, the chance of label 1, from the whole
    text alone. Nothing else of a row enters its score.

    Null and empty texts get what the learned bias says. Texts of any length are scored whole. Rows are scored one by
    one, so repeated rows fare alike. Other columns pass through; where docs has a column quality_score, the result's
    has underscores before it. An empty table gives an empty one.
    """
    columns = docs.columns if columns is None else columns
    out = free("quality_score", docs.columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns]
    needed = in_small_batches(docs).select(*dict.fromkeys([*columns, text]))
    return needed.mapInArrow(_scored(model, text, [f.name for f in needed.schema.fields if f.name in columns], out), ", ".join([*fields, f"`{out}` double"]))
