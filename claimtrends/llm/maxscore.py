"""Exact top-k by inner product with MaxScore.

The terms of a query are its dimensions. Every vector has a posting in every dimension, so a
shard's postings are its columns, and the least and largest value of a column bound what a term
can add. Terms are ordered by the room between their bounds. Those at the end are non-essential:
a vector that adds the least on all the others could not reach the query's current k-th score
with them. Essential columns are traversed for the whole shard; the others are probed a few at a
time for the vectors that their bounds still leave competitive. The scores held go on from shard
to shard of a lane; each lane keeps k rows a query, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages
from .lanes import SHARDS_PER_LANE, matrix, meet, pack, stored

#: Queries of a block, vectors of a shard, columns of one probe.
QUERIES_PER_BLOCK, SHARD, PROBE = 2_048, 4_096, 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v) with floor(scale * x) for each component as long, of rows that take part.

    Rows with a null id or vector, or with a null or non-finite component, do not.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), floor.alias("v")
    )


def search(
    postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int,
    scores: np.ndarray, best: np.ndarray, top: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The best (scores, ids) of those held and of one shard; ``postings`` holds a row per term,
    ``low`` and ``high`` the bounds of each."""
    low, high = low * query, high * query
    least, most = np.minimum(low, high), np.maximum(low, high)
    order = np.argsort(least - most, kind="stable")
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
    floor = np.concatenate([[0], np.cumsum(least[order])])
    full = len(scores) >= top
    bar = scores[-1] if full else -np.inf
    if rest[0] < bar:
        return scores, best
    essential = int(np.argmax(floor + rest < bar)) if full and (floor + rest < bar).any() else len(order)
    part = query[order[:essential]] @ postings[order[:essential]]
    at = np.flatnonzero(part + rest[essential] >= bar)
    part = part[at]
    for start in range(essential, len(order), PROBE):
        terms = order[start: start + PROBE]
        part = part + query[terms] @ postings[np.ix_(terms, at)]
        keep = part + rest[min(start + PROBE, len(order))] >= bar
        at, part = at[keep], part[keep]
    other = ids[at] != own
    scores, best = np.concatenate([scores, part[other]]), np.concatenate([best, ids[at[other]]])
    rank = np.lexsort((best, -scores))[:top]
    return scores[rank], best[rank]


def _bounds(vectors: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
    return {"low": vectors.min(0), "high": vectors.max(0)}


class Shard:
    """A packed shard: its postings, a row per term, and the bounds of each."""

    def __init__(self, row: dict):
        self.ids = matrix(row, "ids")
        own = matrix(row, "v").reshape(len(self.ids), row["width"]).T
        self.longs, self.floats = own, np.ascontiguousarray(own, np.float64)
        self.low, self.high = matrix(row, "low"), matrix(row, "high")
        self.most = max(float(np.abs(self.low).max(initial=0)), float(np.abs(self.high).max(initial=0)))

    def search(
        self, query: np.ndarray, own: int, scores: np.ndarray, best: np.ndarray, top: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """``search`` in a type in which the query's products are exact."""
        limit = self.most * float(np.abs(query).max(initial=0)) * len(query)
        if limit >= 2**62:
            raise ValueError("inner products do not fit a long")
        exact = limit < 2**52
        kind = np.float64 if exact else np.int64
        return search(self.floats if exact else self.longs, self.low.astype(kind), self.high.astype(kind),
                      self.ids, query.astype(kind), own, scores, best, top)


def _searched(pairs: Iterator[tuple[dict, dict]], top: int) -> Iterator[pa.RecordBatch]:
    """The best of a block's queries; their k-th scores are carried on while the block stays."""
    block, ids, queries, held, shards = None, [], [], [], {}

    def told() -> Iterator[pa.RecordBatch]:
        count = [len(s) for s, _ in held]
        if sum(count):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids, count), pa.int64()),
                pa.array(np.concatenate([b for _, b in held]), pa.int64()),
                pa.array(np.concatenate([s for s, _ in held]).astype(np.int64)),
            ], ["query_id", "vec_id", "score"])

    for own, row in pairs:
        if own["pack"] != block:
            yield from told()
            block, ids = own["pack"], matrix(own, "ids")
            queries = matrix(own, "v").reshape(len(ids), own["width"])
            held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        shard = shards.get(row["pack"])
        if shard is None:
            if len(shards) >= SHARDS_PER_LANE:
                shards.clear()
            shard = shards[row["pack"]] = Shard(row)
        for i, own_id in enumerate(ids):
            held[i] = shard.search(queries[i], own_id, *held[i], top)
    yield from told()


def top_k(
    vectors: DataFrame, queries: DataFrame, top: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``top`` highest inner products.

    Both frames are (vec_id, v) as ``quantised`` makes them. A query meets the vectors of its own
    length, but rows of its own id; equal scores rank by vec_id. Repeated vectors are ranked each;
    a repeated query row is answered once. Vectors are read and packed into shards once, and the
    queries, a stated set, into blocks; a lane of shards returns ``top`` rows for each query.
    Products that might not fit a long are an error. An empty side gives an empty result.
    """
    stages = Stages(vectors.sparkSession, "maxscore")
    bare = F.lit(0).cast("long").alias("label")
    fields = {"low": np.int64, "high": np.int64}
    shards = stored(pack(vectors.select("vec_id", "v", bare), SHARD, _bounds, fields, "s"), stages, "shards")
    once = stages.save(queries.groupBy("vec_id", "v").count().select("vec_id", "v", bare), "queries")
    parts = max(1, -(-once.count() // QUERIES_PER_BLOCK))
    dealt = once.repartition(parts, F.xxhash64("vec_id", "v"))
    blocks = stored(pack(dealt, QUERIES_PER_BLOCK, lambda v, labels: {}, {}, "q"), stages, "blocks")
    found = meet(blocks, shards, lambda pairs: _searched(pairs, top), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
