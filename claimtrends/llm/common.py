"""What the operators share: stage tables in the cluster's folder, Arrow batches, text bytes."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that very long texts do not share a batch with many.
BATCH_ROWS, BATCH_BYTES = "2000", "8m"
#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 2_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and give local sessions without one a checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must be set; that folder is used as it is. Functions
    of this subpackage travel to the executors by value: it need not be installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if not shared(spark, missing=""):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(f"{warehouse}/stages")
    return spark


def shared(spark: SparkSession, missing: str | None = None) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share."""
    context = spark.sparkContext
    folder = (
        context.getConf().get("spark.checkpoint.dir")
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
        or missing
    )
    if folder is None:
        raise RuntimeError("call prepare(spark) or set spark.checkpoint.dir")
    return folder.rstrip("/")


class Stages:
    """Tables written to the shared folder, so that a lost executor repeats one stage at most.

    ``save`` returns the stored table; ``drop`` deletes it once no later step reads it. What
    is left goes when the application ends, as results are lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}
        self.root = shared(spark)

    def path(self, name: str) -> str:
        path = f"{self.root}/{self.label}-{name}-{uuid.uuid4().hex}"
        self._files(path)[0].deleteOnExit(self._files(path)[1])
        return path

    def _files(self, path: str) -> tuple:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def save(self, df: DataFrame, name: str, rows: int = 0) -> DataFrame:
        """The stored table; ``rows`` is how many rows a file has at most, 0 for any number."""
        path = self.path(name)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
        schema, self.paths[name] = df.schema, path
        del df
        self.settle()
        return self.spark.read.schema(schema).parquet(path)

    def settle(self) -> None:
        """Let Spark drop the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            files, target = self._files(self.paths.pop(name))
            files.delete(target, True)


def by_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``work`` on each Arrow batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def steps(lengths: np.ndarray, most: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows that hold about ``most`` bytes, one row at least."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield slice(start, stop)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and the n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][: len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def sampled(df: DataFrame, key: str, rows: int, text: str, most: int | None = None) -> DataFrame:
    """At most ``rows`` rows, one of each key, those whose keys hash lowest.

    Of rows with one key, however many, that stays whose text has the least md5, then the least hash
    of all columns; a null key is a key. ``most`` bounds the bytes of the texts together: rows are
    taken in the order of their hashes, and one that no longer fits is passed over, so no text is cut.
    The sample is the same in whatever order the rows come. Only hashes, keys and sizes of about as
    many rows are grouped and sent to the driver; the texts of the sample alone move.
    """
    place, name = F.xxhash64(F.col(key).cast("string")), F.col(key).cast("string")
    same = [F.md5(F.col(text).cast("binary")), F.xxhash64(*df.columns)]
    own = F.struct(same[0].alias("digest"), same[1].alias("hash"), F.octet_length(text).alias("size"))
    different = df.agg(F.approx_count_distinct(place).alias("n")).first().n
    share = 1.5 * rows / max(different, 1)
    while True:
        cut = min(2**63 - 1, int(share * 2**64) - 2**63)
        once = df.where(place <= cut).groupBy(place.alias("place"), name.alias("key")).agg(F.min(own).alias("own"))
        first = once.orderBy("place", "key").limit(rows).select("place", "key", "own.*").collect()
        if len(first) == rows or share >= 1:
            break
        share *= 4
    chosen, total = [], 0
    for r in sorted(first, key=lambda r: (r.place, r.key or "")):
        if most is None or total + (r.size or 0) <= most:
            chosen.append((r.key, r.digest, r.hash))
            total += r.size or 0
    if not chosen:
        return df.limit(0)
    wanted = df.sparkSession.createDataFrame(chosen, "_key string, _digest string, _hash long")
    met = name.eqNullSafe(F.col("_key")) & same[0].eqNullSafe(F.col("_digest")) & (same[1] == F.col("_hash"))
    found = df.where(place <= max(r.place for r in first)).join(F.broadcast(wanted), met)
    return found.dropDuplicates(["_key"]).select(*df.columns)
