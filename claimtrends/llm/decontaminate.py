"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item and a document match if the document holds at least ``threshold`` of the item's shingles.
Items are partitioned by their number of shingles n. With the need m = ceil(threshold * n), a
document that holds m shingles of an item must hold one of any n - m + 1 of them, so the sketch
of an item is its n - m + 1 smallest MinHash values: within a size class the sketches have one
length, no match is missed at any document length, and a document is a candidate only by a value
it has. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, steps, utf8
from .words import LOWER, WORD, grams, prefix_hash, runs, span_hash

#: Words of a shingle, and the share of an item's shingles that a document must hold.
WORDS, THRESHOLD = 5, 0.8
#: Bytes of item texts that one pass over the documents takes along.
BLOCK_BYTES = 16_000_000


class Index(NamedTuple):
    """Items of one block: by shingle length and size class, sketch value to item numbers."""

    ids: list
    shingles: list[frozenset]
    classes: dict[tuple[int, int], tuple[np.ndarray, list[list[int]]]]


def _words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    data = LOWER[data]
    starts, ends, _ = runs(data, np.array([0, len(data)]), WORD)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _shingles(words: list[bytes], n: int) -> frozenset:
    return frozenset(tuple(words[i: i + n]) for i in range(len(words) - n + 1))


def _hashes(shingles: list[tuple]) -> np.ndarray:
    words = [w for s in shingles for w in s]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)
    n = len(shingles[0])
    return grams(h, np.repeat(np.arange(len(shingles)), n), n)[0]


def need(n: int, threshold: float) -> int:
    """Shingles of n that make ``threshold``."""
    return max(1, math.ceil(threshold * n - 1e-9))


def build(items: list[tuple], threshold: float = THRESHOLD) -> Index:
    """The index of (id, text) items. Items without words match nothing and are left out."""
    ids, sets, found = [], [], defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = _words(text)
        if not words:
            continue
        n = min(WORDS, len(words))
        own = _shingles(words, n)
        sketch = np.sort(_hashes(list(own)))[: len(own) - need(len(own), threshold) + 1]
        for value in sketch.tolist():
            found[n, len(sketch)][value].append(len(ids))
        ids.append(item)
        sets.append(own)
    classes = {
        key: (np.array(sorted(of), np.uint64), [of[v] for v in sorted(of)]) for key, of in found.items()
    }
    return Index(ids, sets, classes)


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(text number, item number, shared shingles) of all matches among the texts in ``data``."""
    data = LOWER[data]
    starts, ends, text = runs(data, offsets, WORD)
    if not len(starts):
        return
    hashes = span_hash(prefix_hash(data), starts, ends)
    candidates: dict[int, set[int]] = defaultdict(set)
    of_length: dict[int, tuple] = {}
    for (n, _), (values, items) in index.classes.items():
        if n not in of_length:
            of_length[n] = grams(hashes, text, n)
        h, first = of_length[n]
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        hit = np.flatnonzero(values[at] == h)
        for doc, value in set(zip(text[first[hit]].tolist(), at[hit].tolist(), strict=True)):
            candidates[doc].update(items[value])
    for doc, items in sorted(candidates.items()):
        span = slice(*np.searchsorted(text, [doc, doc + 1]))
        words = [data[s:e].tobytes() for s, e in zip(starts[span].tolist(), ends[span].tolist(), strict=True)]
        own = {n: _shingles(words, n) for n in {len(next(iter(index.shingles[i]))) for i in items}}
        for item in sorted(items):
            wanted = index.shingles[item]
            shared = len(wanted & own[len(next(iter(wanted)))])
            if shared >= need(len(wanted), threshold):
                yield doc, item, shared


def _indexes(items: DataFrame, id_col: str, text: str, threshold: float) -> Iterator[Index]:
    """An index for each block of items; blocks have about BLOCK_BYTES of text."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64(text, id_col), F.lit(blocks))
    for number in range(blocks):
        own = items.where(block == number).select(id_col, text).orderBy(id_col, text)
        index = build([tuple(r) for r in own.collect()], threshold)
        if index.ids:
            yield index


def _matches(batch_text: pa.Array, index: Index, threshold: float) -> Iterator[tuple]:
    data, offsets = utf8(batch_text)
    for part in steps(np.diff(offsets)):
        own = offsets[part.start: part.stop + 1]
        for doc, item, shared in search(index, data[own[0]: own[-1]], own - own[0], threshold):
            yield part.start + doc, item, shared


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) of all matching document and item rows.

    Words are runs of ASCII letters, digits and non-ASCII characters, ASCII capitals made small;
    shingles are distinct runs of five words. An item of fewer words is one shorter shingle. Null
    or empty items and documents match nothing; null ids stay null; repeated rows match as often
    as they come. The items are the query set: they go to every document in blocks of a fixed
    size, one pass over the documents for each block, and documents are never shuffled.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, shared int, shingles int, containment double"
    found = None
    for index in _indexes(items, item_id, text, threshold):

        def work(batch: pa.RecordBatch, index: Index = index) -> pa.RecordBatch:
            ids, rows = batch.column(0), list(_matches(batch.column(1), index, threshold))
            n = [len(index.shingles[item]) for _, item, _ in rows]
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array([doc for doc, _, _ in rows], pa.int64())),
                pa.array([index.ids[item] for _, item, _ in rows], pa.int64()),
                pa.array([shared for _, _, shared in rows], pa.int32()), pa.array(n, pa.int32()),
                pa.array([r[2] / k for r, k in zip(rows, n, strict=True)], pa.float64()),
            ], ["doc_id", "item_id", "shared", "shingles", "containment"])

        part = by_batch(own, work, schema)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """The documents that hold no item, all their columns unchanged."""
    at = docs.columns.index(text)
    for index in _indexes(items, item_id, text, threshold):

        def work(batch: pa.RecordBatch, index: Index = index) -> pa.RecordBatch:
            held = {doc for doc, _, _ in _matches(batch.column(at), index, threshold)}
            return batch.filter(pa.array([i not in held for i in range(batch.num_rows)]))

        docs = by_batch(docs, work, docs.schema)
    return docs
