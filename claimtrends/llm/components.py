"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node each is linked to, over edges a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(label, side, low)
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, label) of every node with an edge, from edges (a, b); labels are nodes.

    In each round every node points to the smallest node beside it, pointers are followed once
    more, and the edges are redrawn between the nodes pointed to. Node numbers should be
    hashes: then trees are shallow and a round removes a constant share of the nodes. Nulls and
    loops are no edges. Each round is stored; nothing is collected but whether edges are left.
    """
    edges = stages.save(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(), "edges0",
    )
    labels, round_ = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("to")
        )
        point = stages.save(point, f"point{round_}")
        far = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
        point2 = stages.save(point.join(far, "to").select("node", "far"), f"jump{round_}")
        of = lambda side: point2.select(F.col("node").alias(side), F.col("far").alias("n" + side))  # noqa: E731,B023
        redrawn = edges.join(of("a"), "a").join(of("b"), "b").where("na <> nb").select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")
        ).distinct()
        step = point2.select(F.col("node").alias("label"), F.col("far").alias("next"))
        if labels is None:
            labels = point2.select("node", F.col("far").alias("label"))
        else:
            labels = labels.join(step, "label", "left").select(
                "node", F.coalesce("next", "label").alias("label")
            )
            labels = stages.save(labels, f"labels{round_}")
        edges = stages.save(redrawn, f"edges{round_ + 1}")
        round_ += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
