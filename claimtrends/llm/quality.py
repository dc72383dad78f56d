"""Quality scores: logistic regression on hashed word n-grams, learned by FTRL-proximal.

Tokens are words and runs of other signs, as they stand. Features are hashed 1- and 2-grams with
weight log(1 + count), and the share of the text in n-grams that come once, twice, four times and
so on; a text's features have length one. A score is a sparse dot product.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, sampled, steps, utf8
from .words import WORD, byte_table, grams, prefix_hash, runs, span_hash

#: Buckets for hashed n-grams, the longest n-gram, and buckets for shares of repeated n-grams.
BUCKETS, ORDER, TIMES = 1 << 18, 2, 8
#: Labelled texts learned from at most, texts of a learner, whose weights are averaged, and their
#: bytes together.
SAMPLE, PER_LEARNER, SAMPLE_BYTES = 16_000, 2_000, 256_000_000
#: FTRL: learning rate, its offset, penalties, and passes over a learner's texts.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.001, 0.0, 5

_SIGN = ~WORD & ~byte_table(b"\x20\t\n\v\f\r")
_FIRST = 1 + ORDER * TIMES  # after the bias and the shares


class Features(NamedTuple):
    """Sparse rows: text r has columns[start[r]:start[r + 1]] with these values."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    """Feature rows of texts in one byte array. A text without tokens has the bias alone."""
    n = len(offsets) - 1
    found = [runs(data, offsets, table) for table in (WORD, _SIGN)]
    starts, ends, text = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, text = starts[order], ends[order], text[order]
    hashes = span_hash(prefix_hash(data), starts, ends)
    rows, columns, values = [np.arange(n)], [np.zeros(n, np.int64)], [np.full(n, 0.3)]
    for size in range(1, ORDER + 1):
        h, first = grams(hashes, text, size)
        key = text[first].astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
        key, count = np.unique(key, return_counts=True)
        row = (key >> np.uint64(40)).astype(np.int64)
        rows.append(row)
        columns.append((key % np.uint64(BUCKETS)).astype(np.int64) + _FIRST)
        values.append(np.log1p(count))
        times = np.minimum(np.log2(count).astype(np.int64), TIMES - 1)
        share = np.bincount(row * TIMES + times, weights=count, minlength=n * TIMES).reshape(n, TIMES)
        share = share / np.maximum(share.sum(1, keepdims=True), 1)
        at, level = np.nonzero(share)
        rows.append(at)
        columns.append(1 + (size - 1) * TIMES + level)
        values.append(share[at, level])
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    # n-grams weigh as much together as the shares and the bias
    hashed = column >= _FIRST
    norm = np.sqrt(np.bincount(row, weights=np.where(hashed, value**2, 0), minlength=n))
    value = np.where(hashed, value / np.maximum(norm[row], 1e-9), value)
    order = np.argsort(row, kind="stable")
    return Features(np.searchsorted(row[order], np.arange(n + 1)), column[order], value[order])


def _in_steps(data: np.ndarray, offsets: np.ndarray) -> Features:
    """``features`` a step of texts at a time, kept in small types."""
    starts, columns, values, base = [np.zeros(1, np.int64)], [], [], 0
    for part in steps(np.diff(offsets)):
        own = offsets[part.start: part.stop + 1]
        rows = features(data[own[0]: own[-1]], own - own[0])
        starts.append(rows.start[1:] + base)
        columns.append(rows.columns.astype(np.int32))
        values.append(rows.values.astype(np.float32))
        base += len(rows.columns)
    return Features(*(np.concatenate(x) for x in (starts, columns, values)))


def learn(rows: Features, labels: np.ndarray, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """Weights after FTRL-proximal updates, text by text in a fixed shuffled order."""
    size = _FIRST + BUCKETS
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for r in rng.permutation(len(labels)):
            span = slice(rows.start[r], rows.start[r + 1])
            at, x = rows.columns[span], rows.values[span]
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[r]) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def score(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = features(data, offsets)
    total = np.concatenate([[0], np.cumsum(weights[rows.columns] * rows.values)])
    dot = total[rows.start[1:]] - total[rows.start[:-1]]
    return 1 / (1 + np.exp(-np.clip(dot, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from (doc_id, text) and (doc_id, label 0 or 1); other rows play no part.

    At most ``sample`` labelled ids are learned from, those that hash lowest, which is what is
    broadcast; an id with both labels has the smaller. One text of each id is, that of the least
    md5, however many rows repeat the id, and the texts have SAMPLE_BYTES at most: one that does not fit
    is left out whole. Learners take equal shares of at most about PER_LEARNER in tasks of their own,
    and the weights, a bounded vector each, are averaged. Without any labelled text weights are zero.
    """
    spark = docs.sparkSession
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample).collect()
    learners = max(1, -(-len(chosen) // PER_LEARNER))
    rows = spark.createDataFrame(
        [(r.doc_id, int(r.label), i % learners) for i, r in enumerate(sorted(chosen))],
        "doc_id long, label int, learner int",
    )
    own = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows), "doc_id")
    own = sampled(own, "doc_id", sample, "text", SAMPLE_BYTES)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label", "text"], kind="stable")
        data, offsets = utf8(pa.array(rows["text"].tolist(), pa.large_string()))
        w = learn(_in_steps(data, offsets), rows["label"].to_numpy(float))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    found = own.groupBy("learner").applyInPandas(train, "at int, w double")
    weights = np.zeros(_FIRST + BUCKETS)
    # one weight of each learner, added in order so that the sum is always the same
    total = F.aggregate(F.sort_array(F.collect_list("w")), F.lit(0.0), lambda a, w: a + w)
    found = found.groupBy("at").agg(total.alias("w")).toArrow()
    weights[found["at"].to_numpy()] = found["w"].to_numpy() / learners
    return weights


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text): the likelihood of label 1, from 0 to 1.

    Null and empty texts get the score of a text without tokens. Repeated rows are scored each.
    """
    weights = weights.astype(np.float32)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column(1))
        out = []
        for part in steps(np.diff(offsets)):
            own = offsets[part.start: part.stop + 1]
            out.append(score(weights, data[own[0]: own[-1]], own - own[0]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double")
