"""Near-duplicates by SimHash, linked through vantage-point trees.

Fingerprints are points under the Hamming distance. A node of a tree holds a vantage point and
a cut: points no further than the cut go inside, the rest outside. By the triangle inequality
two points within r of each other can only be parted if the inner one lies within r of the cut,
so points of that band are also copied outside, and every pair meets in some leaf. The upper
part of a tree deals the fingerprints to shards, the lower part prunes inside a shard.

A pair that differs in k bits differs in at most k // parts bits in one of ``parts`` equal
slices. There is one tree per slice, on the distance within that slice, which has the smaller
radius k // parts: bands are narrow, so few points are copied. Leaves compare whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, by_batch
from .components import components, local_components

WORDS, SEED, BITS = 3, 42, 64
#: Links differ in so many bits at most; slices of a fingerprint, each with a tree.
MAX_BITS, PARTS = 3, 2
#: Fingerprints that a shard should hold, shards at most, and sampled points for each of them.
SHARD, MAX_SHARDS, PER_SHARD = 16_384, 4_096, 8
#: Points that a leaf inside a shard compares pairwise.
LEAF = 96

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FULL = np.uint64(2**64 - 1)


def fingerprint(text: str | None, block: int = 65_536) -> int:
    """64-bit SimHash of the 3-word shingles; 0 for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, n - WORDS + 1)
    starts, ends = starts[:count].tolist(), ends[min(WORDS, n) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, count, block):
        spans = zip(starts[at: at + block], ends[at: at + block], strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``fp``, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64)
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], [*rest, "fp"])

    return by_batch(docs, work, f"{fields}, fp long" if fields else "fp long")


# Trees -------------------------------------------------------------------------------------


def _distance(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask).astype(np.int16)


def _cut(points: np.ndarray, metrics: list[tuple], rng: np.random.Generator) -> tuple | None:
    """(mask, radius, vantage, cut) that splits best, or None where all points look alike."""
    for mask, radius in metrics:
        best, n = None, len(points)
        for vantage in rng.choice(points, min(4, n), replace=False):
            share = np.bincount(_distance(points, vantage, mask), minlength=BITS + 1).cumsum() / n
            for cut in range(BITS):
                inner = share[cut]
                outer = 1 - (share[cut - radius] if cut >= radius else 0)
                cost = inner**1.3 + outer**1.3
                if 0 < inner and outer < 1 and (best is None or cost < best[0]):
                    best = cost, mask, radius, vantage, cut
        if best and best[0] < 0.99:
            return best[1:]
    return None


def grow(points: np.ndarray, shards: int, metrics: list[tuple], rng, leaf: Iterator[int]) -> tuple:
    """A tree of about ``shards`` leaves from sampled points: (leaf,) or (cut, inner, outer)."""
    split = _cut(points, metrics, rng) if shards > 1 and len(points) > 1 else None
    if split is None:
        return (next(leaf),)
    mask, radius, vantage, cut = split
    d = _distance(points, vantage, mask)
    inner, outer = points[d <= cut], points[d > cut - radius]
    part = max(1, min(shards - 1, round(shards * len(inner) / (len(inner) + len(outer)))))
    return (
        split,
        grow(inner, part, metrics, rng, leaf),
        grow(outer, shards - part, metrics, rng, leaf),
    )


def route(points: np.ndarray, tree: tuple, rows: np.ndarray | None = None) -> Iterator[tuple]:
    """(leaf, rows of ``points`` that it holds), band copies included."""
    rows = np.arange(len(points)) if rows is None else rows
    if not len(rows):
        return
    if len(tree) == 1:
        yield tree[0], rows
        return
    (mask, radius, vantage, cut), inner, outer = tree
    d = _distance(points[rows], vantage, mask)
    yield from route(points, inner, rows[d <= cut])
    yield from route(points, outer, rows[d > cut - radius])


def _pairs(points: np.ndarray, rows: np.ndarray, bits: int) -> Iterator[tuple]:
    own, size = points[rows], 512
    for at in range(0, len(own), size):
        near = np.bitwise_count(own[at: at + size, None] ^ own[None, :]) <= bits
        i, j = np.nonzero(near)
        keep = i + at < j
        yield rows[i[keep] + at], rows[j[keep]]


def links(points: np.ndarray, metrics: list[tuple], bits: int, seed: int = 7) -> tuple:
    """Index pairs that join all points within ``bits`` of each other, as stars.

    The tree goes on inside the shard. Links are folded into local components as they come up,
    so that a dense group never becomes a list of its pairs.
    """
    rng, label = np.random.default_rng(seed), np.arange(len(points))
    work, held, size = [(np.arange(len(points)), 0)], [], 0

    def fold() -> None:
        nonlocal label, held, size
        if held:
            a, b = (label[np.concatenate(x)] for x in zip(*held, strict=True))
            label = local_components(len(points), a, b)[label]
            held, size = [], 0

    while work:
        rows, depth = work.pop()
        split = _cut(points[rows], metrics, rng) if LEAF < len(rows) and depth < 60 else None
        if split is not None:
            mask, radius, vantage, cut = split
            d = _distance(points[rows], vantage, mask)
            inner, outer = rows[d <= cut], rows[d > cut - radius]
            if max(len(inner), len(outer)) < len(rows):
                work += [(inner, depth + 1), (outer, depth + 1)]
                continue
        for pair in _pairs(points, rows, bits):
            held.append(pair)
            size += len(pair[0])
            if size > 1_000_000:
                fold()
    fold()
    star = np.flatnonzero(label != np.arange(len(points)))
    return star, label[star]


def linked(fps: DataFrame, stages: Stages, bits: int = MAX_BITS, parts: int = PARTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps`` (fp), enough to join all within ``bits``."""
    total = fps.count()
    shards = max(1, min(MAX_SHARDS, -(-total // SHARD)))
    sample = fps.orderBy(F.xxhash64("fp")).limit(PER_SHARD * shards if shards > 1 else 1)
    points = np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)
    width = BITS // parts
    slices = [np.uint64(((1 << width) - 1) << (width * p)) for p in range(parts)]
    metrics = [[(mask, bits // parts), (_FULL, bits)] for mask in slices]
    leaf, rng = iter(range(10**9)), np.random.default_rng(11)
    trees = [grow(points, shards, m, rng, leaf) for m in metrics]
    first = [min(_leaves(t)) for t in trees] + [next(leaf)]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        found = [x for tree in trees for x in route(own.view(np.uint64), tree)]
        at = np.concatenate([np.full(len(rows), leaf, np.int32) for leaf, rows in found])
        rows = np.concatenate([rows for _, rows in found])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[rows])], ["shard", "fp"])

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        own = shard["fp"].to_numpy()
        part = int(np.searchsorted(first, shard["shard"].iloc[0], "right")) - 1
        a, b = links(own.view(np.uint64), metrics[part], bits)
        return pd.DataFrame({"a": own[a], "b": own[b]})

    dealt = by_batch(fps.select("fp"), deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _leaves(tree: tuple) -> Iterator[int]:
    if len(tree) == 1:
        yield tree[0]
    else:
        yield from _leaves(tree[1])
        yield from _leaves(tree[2])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    bits: int = MAX_BITS, parts: int = PARTS,
) -> DataFrame:
    """One row per document: its id, ``md5`` of its text, ``fingerprint`` and ``component_id``.

    component_id is the smallest id that links of at most ``bits`` differing bits reach; null if
    all ids reached are null. Null and empty texts have fingerprint zero and are linked like any
    other; repeated rows stay, in one component. Other columns are not looked at. An empty table
    gives an empty result.

    Copies collapse into one fingerprint before anything is dealt, so a text that a third of the
    documents share is one point. Texts are read once and never shuffled.
    """
    stages = Stages(docs.sparkSession, "simhash")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.md5(F.col(text).cast("binary")).alias("md5"),
        F.col(text).alias("text"),
    )
    prints = stages.save(with_fingerprints(slim), "prints")
    fps = stages.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    labels = components(linked(fps, stages, bits, parts), stages)
    of = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    known = stages.save(of.join(least, "label").select("fp", "component_id"), "known")
    return prints.join(known, "fp").select(
        "doc_id", "md5", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each near-duplicate component: the smallest id, then the smallest md5.

    Rows equal in both are one document and stay once. A document without near-duplicates stays.
    Texts are shuffled once, by id and md5, after equal rows of a task have become one.
    """
    found = near_duplicates(docs, id_col, text)
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("md5"))).alias("best")
    best = found.groupBy(group.alias("g")).agg(best).select("best.doc_id", "best.md5")
    best = best.select(_key(F.col("doc_id"), "_id"), _key(F.col("md5"), "_md5"))
    best = Stages(docs.sparkSession, "simhash").save(best, "best")
    keyed = docs.select("*", _key(F.col(id_col), "_id"), _key(F.md5(F.col(text).cast("binary")), "_md5"))
    once = keyed.dropDuplicates(["_id", "_md5"])
    return once.join(best, ["_id", "_md5"], "left_semi").select(*docs.columns)


def _key(value: Column, name: str) -> Column:
    """A value as text that is never null, null told from all others."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string"))).alias(name)
