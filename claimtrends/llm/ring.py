"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard sits on the ring at many virtual nodes; a key belongs to the first node clockwise of
its hash. A shard takes no more than its capacity: keys that find it full go on clockwise to the
next node with room. Only counts of the ring's arcs reach the driver, whose number is fixed by
the parameters; which key of an arc goes where follows from its rank within the arc.
"""

from __future__ import annotations

from collections import deque

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages

#: Positions of the ring, virtual nodes of each shard, and parts in which ranks of an arc are counted.
POSITIONS, NODES, PARTS = 65_536, 128, 1_024


def nodes(shards: int, virtual: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. One more shard only adds nodes."""
    at = [
        (xxhash.xxh64_intdigest(f"{shard}/{node}") % POSITIONS, shard)
        for shard in range(shards) for node in range(virtual)
    ]
    return sorted(at)


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take: with no slack, counts at most one apart."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def place(counts: dict[int, int], ring: list[tuple[int, int]], room: list[int]) -> list[tuple]:
    """(arc, first rank, end rank, shard, first slot) for arcs holding ``counts`` keys.

    Own keys go first, in ring order; what overflows walks clockwise, first come first served.
    """
    room, used, pieces = list(room), [0] * len(room), []
    waiting: dict[int, list[tuple[int, int]]] = {}

    def take(arc: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, room[shard] - used[shard])
        if n:
            pieces.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n
        return start + n

    for arc, (_, shard) in enumerate(ring):
        rest = take(arc, 0, counts.get(arc, 0), shard)
        if rest < counts.get(arc, 0):
            waiting[arc] = [(rest, counts[arc])]
    walking: deque[tuple[int, int, int]] = deque()
    for step in range(2 * len(ring)):
        arc = step % len(ring)
        while walking and used[ring[arc][1]] < room[ring[arc][1]]:
            origin, start, end = walking.popleft()
            rest = take(origin, start, end, ring[arc][1])
            if rest < end:
                walking.appendleft((origin, rest, end))
        walking.extend((arc, *x) for x in waiting.pop(arc, []))
    assert not walking and not waiting, "the shards have less room than there are rows"
    return pieces


def _arcs(spark: SparkSession, ring: list[tuple[int, int]]) -> DataFrame:
    """The arc of each position; as many rows as the ring has positions."""
    rows, arc = [], 0
    for position in range(POSITIONS):
        while arc < len(ring) and ring[arc][0] < position:
            arc += 1
        rows.append((position, arc % len(ring)))
    return spark.createDataFrame(rows, "position int, arc int")


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text",
    slack: float = 0.0, virtual: int = NODES,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot, its place in the shard.

    size is the bytes of the text and 8 more; a null text has no bytes and checksum 0. Without
    slack the shards' counts are at most one apart; with it a shard holds at most
    ``ceil((1 + slack) * rows / shards)`` and fewer keys leave their own. Slots run from 0 without
    gaps. Repeated ids, null ids included, lie on one arc and are told apart by rank, so that
    even an id of a third of all rows is spread: ranks are counted per part of the input, of which
    there are PARTS at most, and then offset, never over a whole arc in one task. Other columns are not looked at; an
    empty table gives an empty result.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "ring")
    ring = nodes(shards, virtual)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(id_col), F.lit(POSITIONS)).cast("int").alias("position"),
    )
    dealt = slim.join(F.broadcast(_arcs(spark, ring)), "position").drop("position")
    dealt = stages.save(dealt.withColumn("part", F.spark_partition_id() % PARTS), "arcs")
    counts = stages.save(dealt.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r.arc: r.n for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    room = capacities(sum(totals.values()), shards, slack)
    pieces = spark.createDataFrame(
        place(totals, ring, room), "arc int, first long, last long, shard int, base long"
    )
    before = F.sum("n").over(
        Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("arc", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    order = Window.partitionBy("arc", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["arc", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset")).drop("offset")
    pieces = F.broadcast(pieces.withColumnRenamed("arc", "own"))
    inside = (F.col("arc") == F.col("own")) & F.col("rank").between(F.col("first"), F.col("last") - 1)
    return ranked.join(pieces, inside).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
    )
