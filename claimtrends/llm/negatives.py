"""Hard negatives by a cover tree over norm-augmented vectors.

One more component brings all candidates of a shard to the same norm, which leaves inner products
with an anchor as they are and turns them into distances on a sphere. A cover tree halves its
covering radius from level to level: centres of a node are picked farthest first until each point
is within half the radius of one. The angle of a centre and the covering radius bound the inner
products of all points below. Nodes are taken best bound first; one whose bounds miss all score
windows of an anchor, or what it already holds in them, is skipped, and points are verified exactly.

Positives and negatives are two such searches. The windows of the second come from the first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages
from .lanes import matrix, meet, pack, stored

#: Vectors of a shard, anchors of a block, points of a leaf.
SHARD, BLOCK, LEAF = 4_096, 1_024, 32
#: Positives and negatives wanted, and the window of a negative's score in percent.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Room for rounding: of squared radii, and of bounds, as shares of the largest value.
_SQUARE, _BOUND = 1e-11, 1e-6
#: LOW to HIGH in lowest terms, and a bound beyond all scores.
_RATIO, _ALL = Fraction(LOW, HIGH).as_integer_ratio(), 2**62

_FIELDS = {"centre": np.int32, "radius": np.float64, "first": np.int32, "end": np.int32,
           "child": np.int32, "children": np.int32, "least": np.int64, "most": np.int64}


def cover_tree(points: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of a cover tree, breadth first, and the ``order`` in which each node's points are a range.

    A node has a centre (a point), its covering radius in augmented space, its points, its
    children (none: a leaf) and the least and greatest label of its points.
    """
    x = points.astype(np.float64)
    norms = (x * x).sum(1)
    top = float(norms.max(initial=0))
    x = np.concatenate([x, np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)
    slack, order = _SQUARE * top, np.arange(len(x))

    def away(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.maximum(2 * top - 2 * (x[rows] @ x[centre]), 0) + slack

    middle = int((x @ x.mean(0)).argmax())
    nodes = [[middle, float(away(order, middle).max()), 0, len(x), 0, 0]]
    at = 0
    while at < len(nodes):
        centre, square, first, end = nodes[at][:4]
        if end - first > LEAF and square > 4 * slack:
            rows = order[first:end]
            near, of, centres = away(rows, centre), np.zeros(len(rows), np.int64), [centre]
            while near[far := int(near.argmax())] > square / 4:
                own = away(rows, int(rows[far]))
                closer = own < near
                near[closer], of[closer] = own[closer], len(centres)
                centres.append(int(rows[far]))
            order[first:end] = rows[np.argsort(of, kind="stable")]
            widest = np.zeros(len(centres))
            np.maximum.at(widest, of, near)
            stops = first + np.bincount(of).cumsum()
            nodes[at][4:] = len(nodes), len(centres)
            starts = np.concatenate([[first], stops[:-1]])
            nodes += [[*n, 0, 0] for n in zip(centres, widest.tolist(), starts.tolist(), stops.tolist(), strict=True)]
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    centre, square, first, end, child, children = (np.array(c) for c in zip(*nodes, strict=True))
    own = labels[order]
    return {
        "order": order, "centre": place[centre], "radius": np.sqrt(square), "first": first, "end": end,
        "child": child, "children": children,
        "least": np.array([own[a:b].min() for a, b in zip(first, end, strict=True)]),
        "most": np.array([own[a:b].max() for a, b in zip(first, end, strict=True)]),
    }


class Shard:
    """A packed shard with its tree, ready to be searched."""

    def __init__(self, row: dict):
        self.ids, self.labels = matrix(row, "ids"), matrix(row, "labels")
        self.v = matrix(row, "v").reshape(len(self.ids), row["width"])
        for name, kind in _FIELDS.items():
            setattr(self, name, matrix(row, name, kind))
        self.most_abs = float(np.abs(self.v).max(initial=0))
        self.float = self.v.astype(np.float64)
        self.norm = float(np.sqrt((self.float**2).sum(1).max(initial=0)))
        self.angle = 2 * np.arcsin(np.minimum(1, self.radius / (2 * self.norm))) if self.norm else 0 * self.radius

    def values(self, query: np.ndarray) -> np.ndarray:
        """The points in a type in which the query's products are exact."""
        limit = self.most_abs * float(np.abs(query).max(initial=0)) * self.v.shape[1]
        if limit >= 2**59:
            raise ValueError("inner products do not fit a long")
        return self.float if limit < 2**52 else self.v

    def bounds(self, products: np.ndarray, nodes: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) inner products of the nodes' points with a query of this length."""
        scale = length * self.norm
        angle = np.arccos(np.clip(products / scale, -1, 1)) if scale else np.zeros(len(nodes))
        wide, room = self.angle[nodes], _BOUND * scale + _BOUND
        return (scale * np.cos(np.maximum(angle - wide, 0)) + room,
                scale * np.cos(np.minimum(angle + wide, np.pi)) - room)


class Windows:
    """The best scores found for one anchor in each of its score windows."""

    def __init__(self, anchor: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, top: int):
        self.anchor, self.label, self.same, self.top = anchor, label, same, top
        self.low, self.high, self.bar = low, high, low.copy()
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]

    def wants(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return ((upper[:, None] >= self.bar) & (lower[:, None] <= self.high)).any(1)

    def offer(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Take in points by their exact scores."""
        fit = ((labels == self.label) == self.same) & (ids != self.anchor)
        fit &= (scores >= self.bar.min()) & (scores <= self.high.max())
        scores, ids = scores[fit].astype(np.int64), ids[fit]
        if not len(ids):
            return
        for k, (best, names) in enumerate(self.held):
            own = (scores >= self.bar[k]) & (scores <= self.high[k])
            if own.any():
                best, names = np.concatenate([best, scores[own]]), np.concatenate([names, ids[own]])
                rank = np.lexsort((names, -best))[: self.top]
                self.held[k] = best[rank], names[rank]
                if len(rank) == self.top:
                    self.bar[k] = best[rank[-1]]


def descend(shard: Shard, query: np.ndarray, found: Windows) -> None:
    """Best-first descent of a shard's tree; all points that belong into the windows are offered."""
    values, length = shard.values(query), float(np.sqrt((query.astype(np.float64) ** 2).sum()))
    query = query.astype(values.dtype)
    kinds = (shard.least, shard.most)

    def push(heap: list, nodes: np.ndarray, products: np.ndarray) -> None:
        upper, lower = shard.bounds(products, nodes, length)
        least, most = kinds[0][nodes], kinds[1][nodes]
        if found.same:
            labels = (least <= found.label) & (most >= found.label)
        else:
            labels = (least != found.label) | (most != found.label)
        for i in np.flatnonzero(labels & found.wants(upper, lower)):
            heapq.heappush(heap, (-upper[i], int(nodes[i]), lower[i]))

    heap: list = []
    root = np.array([0])
    push(heap, root, values[shard.centre[root]] @ query)
    while heap:
        upper, node, lower = heapq.heappop(heap)
        if not found.wants(np.array([-upper]), np.array([lower]))[0]:
            continue
        n = shard.children[node]
        if not n:
            a, b = shard.first[node], shard.end[node]
            found.offer(values[a:b] @ query, shard.ids[a:b], shard.labels[a:b])
            continue
        nodes = np.arange(shard.child[node], shard.child[node] + n)
        at = shard.centre[nodes]
        products = values[at] @ query
        single = shard.end[nodes] - shard.first[nodes] == 1
        found.offer(products[single], shard.ids[at[single]], shard.labels[at[single]])
        push(heap, nodes[~single], products[~single])


_FOUND = "block string, row int, anchor_id long, window int, vec_id long, score long"


def _searched(pairs: Iterator[tuple[dict, dict]], same: bool, top: int) -> Iterator[pa.RecordBatch]:
    """Windows of a block's anchors, carried on from shard to shard while the block stays."""
    block, held, shards = None, [], {}

    def told() -> Iterator[pa.RecordBatch]:
        rows = [(block, i, w.anchor, k, int(v), int(s)) for i, w in held
                for k, (scores, ids) in enumerate(w.held) for s, v in zip(scores, ids, strict=True)]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "row", "anchor_id", "window", "vec_id", "score"])

    for own, row in pairs:
        if own["pack"] != block:
            yield from told()
            block, ids, labels = own["pack"], matrix(own, "ids"), matrix(own, "labels")
            queries = matrix(own, "v").reshape(len(ids), own["width"])
            if same:
                all_ = np.array([_ALL])
                held = [(i, Windows(int(a), int(x), True, -all_, all_, top))
                        for i, (a, x) in enumerate(zip(ids, labels, strict=True))]
            else:
                scores: dict[int, list[int]] = {}
                for i, score in own["windows"]:
                    scores.setdefault(i, []).append(score)
                held = []
                for i, own_scores in sorted(scores.items()):
                    high = np.array(own_scores, np.int64)
                    low = -((-_RATIO[0] * high) // _RATIO[1])
                    held.append((i, Windows(int(ids[i]), int(labels[i]), False, low, high, top)))
        shard = shards.get(row["pack"])
        if shard is None:
            if len(shards) >= 16:
                shards.clear()
            shard = shards[row["pack"]] = Shard(row)
        for i, found in held:
            descend(shard, queries[i], found)
    yield from told()


def quantised(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
) -> DataFrame:
    """(vec_id, v, label) with floor(scale * x) as long, of rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, do not.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = F.col(id_col).isNotNull() & F.col(label).isNotNull()
    return vectors.where(there & fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        F.col(label).cast("long").alias("label"),
    )


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both frames are (vec_id, v, label) as ``quantised`` makes them. An anchor's positives are its
    highest products among other rows of its label; for each of them come the highest among rows of
    other labels with LOW * positive <= HIGH * negative <= HIGH * positive. Equal scores rank by
    vec_id. An anchor meets rows of its own length, but none of its own id; repeated rows are ranked
    each, a repeated anchor row is answered once. Anchors without positives, and positives without
    negatives in the window, have no rows, as with a positive below zero; empty tables give none.
    Products of 59 bits and more are an error.
    """
    stages = Stages(vectors.sparkSession, "negatives")
    shards = stored(pack(vectors, SHARD, cover_tree, _FIELDS, "s"), stages, "shards")
    once = stages.save(anchors.groupBy("vec_id", "v", "label").count().drop("count"), "anchors")
    parts = max(1, -(-once.count() // BLOCK))
    dealt = once.repartition(parts, F.xxhash64("vec_id", "v", "label"))
    blocks = stored(pack(dealt, BLOCK, lambda v, labels: {}, {}, "q"), stages, "blocks")

    def ranked(found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("block", "row", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    first = meet(blocks, shards, lambda pairs: _searched(pairs, True, positives), _FOUND)
    first = stages.save(ranked(first, positives).select(
        "block", "row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.col("rank") - 1).alias("window")), "positives")
    # of a block's positives, which its size bounds, in the order of their ranks
    listed = first.groupBy("block").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("row", "window", "positive_score"))),
        lambda x: F.struct(x["row"].alias("row"), x["positive_score"].alias("score")),
    ).alias("windows"))
    asked = stored(blocks.join(listed.withColumnRenamed("block", "pack"), "pack"), stages, "windows")
    asked = asked.withColumn("windows", F.transform("windows", lambda x: F.array(x["row"].cast("long"), x["score"])))
    second = ranked(meet(asked, shards, lambda pairs: _searched(pairs, False, negatives), _FOUND), negatives)
    return second.join(first, ["block", "row", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
