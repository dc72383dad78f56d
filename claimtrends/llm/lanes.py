"""Vectors in packed shards, and a stated set of queries that meets all of them.

A shard is a row that holds a few thousand vectors as one array, with whatever index was built
over them; a block is a row with many queries. Shards are dealt to lanes, and each lane gets all
blocks: shards move once, blocks once for each lane. Nothing is collected, and the plan and the
number of reads are the same for any number of queries. Within a lane the blocks are streamed
and the shards follow one another for each block, so that what a block has found so far can
be passed on from shard to shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

#: Shards of a lane beyond LANES lanes; rows of one stored file, which bound a reader's batch.
SHARDS_PER_LANE, LANES, ROWS_PER_FILE = 16, 64, 16

Index = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def pack(rows: DataFrame, size: int, index: Index, fields: dict[str, type], kind: str) -> DataFrame:
    """Shards or blocks of (vec_id, v, label) rows: a key, width, ids, v, labels and index arrays.

    ``index`` maps a matrix of longs and its labels to the arrays named in ``fields`` and, if it
    likes, an ``order`` for the rows. Vectors of different lengths lie in different packs; rows of
    a partition are packed as they come, at most ``size`` in one.
    """
    names = ["pack", "width", "ids", "v", "labels", *fields]
    schema = "pack string, width int, " + ", ".join(f"{n} binary" for n in names[2:])

    def one(held: list[tuple[np.ndarray, ...]], width: int) -> pa.RecordBatch:
        ids, flat, labels = (np.concatenate(x) for x in zip(*held, strict=True))
        matrix = flat.reshape(len(ids), width)
        found = index(matrix, labels)
        order = found.pop("order", slice(None))
        ids, matrix, labels = ids[order], matrix[order], labels[order]
        parts = [x.astype(np.int64).tobytes() for x in (ids, matrix, labels)]
        parts += [np.ascontiguousarray(found[n], t).tobytes() for n, t in fields.items()]
        key = kind + hashlib.blake2b(b"".join(parts), digest_size=16).hexdigest() + str(width)
        columns = [pa.array([key]), pa.array([width], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        count: dict[int, int] = {}
        for batch in batches:
            ids, lists, labels = batch.column(0), batch.column(1), batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():
                rows_ = np.flatnonzero(lengths == width)
                while len(rows_):
                    room = size - count.get(width, 0)
                    own, rows_ = pa.array(rows_[:room]), rows_[room:]
                    part = [x.take(own) for x in (ids, lists, labels)]
                    part[1] = part[1].flatten()
                    open_.setdefault(width, []).append(tuple(p.to_numpy(zero_copy_only=False) for p in part))
                    count[width] = count.get(width, 0) + len(own)
                    if count[width] == size:
                        yield one(open_.pop(width), width)
                        del count[width]
        for width, held in open_.items():
            yield one(held, width)

    return rows.select("vec_id", "v", "label").mapInArrow(run, schema)


def matrix(row: dict, name: str, dtype: type = np.int64) -> np.ndarray:
    """An array of a packed row."""
    return np.frombuffer(row[name], dtype)


def stored(packs: DataFrame, stages: Stages, name: str) -> DataFrame:
    """``packs`` in files of few rows, as one row may hold megabytes."""
    return stages.save(packs, name, rows=ROWS_PER_FILE)


def meet(blocks: DataFrame, shards: DataFrame, work: Callable[[str, dict, list[dict]], Iterator], schema: str) -> DataFrame:
    """What ``work`` makes of each block and each shard of the same width.

    Both are stored packs; the blocks' columns get the prefix ``q_``. ``work`` is a function of
    the iterator of (block row, shard row) of a task, in which the shards of a lane follow one
    another for each block, and gives record batches of ``schema``.
    """
    n = shards.count()
    lanes = max(1, min(n, max(LANES, -(-n // SHARDS_PER_LANE))))
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    left = blocks.select(every, *[F.col(c).alias(f"q_{c}") for c in blocks.columns])
    right = shards.withColumn("lane", F.pmod(F.xxhash64("pack"), F.lit(lanes)).cast("int"))
    left, right = left.repartition(lanes, "lane"), right.repartition(lanes, "lane")
    pairs = left.join(right.hint("merge"), "lane").where(F.col("q_width") == F.col("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, dict]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                    yield ({c[2:]: x for c, x in row.items() if c.startswith("q_")},
                           {c: x for c, x in row.items() if not c.startswith("q_")})

        yield from work(rows())

    return pairs.drop("lane").mapInArrow(run, schema)
