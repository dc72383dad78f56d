"""Row windows over series that are too long for one task.

A series is a few dozen quarters, but a catch-all code can hold very many product names
per quarter. Every feature looks back a fixed number of rows, so such a series can be cut
into blocks of its row order, each led by the last rows of the block before. The blocks
spread over the cluster and give the same values as the whole series would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import SeriesSpec
from ..sources.tables import checkpoint_table
from .joins import attach, keep_matching

MAX_ROWS = 1_000_000

Transform = Callable[[DataFrame, SeriesSpec], DataFrame]


def over_series(
    df: DataFrame,
    spec: SeriesSpec,
    transform: Transform,
    lookback: int,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """``transform(df, spec)``, with series above ``max_rows`` rows computed in blocks.

    A stored table that has no more rows than that in all has no longer series, and is not
    counted. Otherwise the count reads the keys alone, and ``df`` is read again after it.
    """
    rows = getattr(df, "stored_rows", None)
    if rows is not None and rows <= max_rows:
        return transform(df, spec)
    sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("rows"))
    long_keys = sizes.where(F.col("rows") > max_rows).select(*spec.keys)
    if long_keys.isEmpty():
        return transform(df, spec)
    long_keys = checkpoint_table(long_keys, "long-series")
    usual = keep_matching(df, long_keys, spec.keys, "left_anti")
    long = keep_matching(df, long_keys, spec.keys, "left_semi")
    in_blocks = replace(spec, keys=(*spec.keys, "__block"))
    blocks = transform(_blocks(long, spec, max_rows, lookback), in_blocks)
    own_rows = blocks.where(~F.col("__halo")).drop("__block", "__halo")
    return transform(usual, spec).unionByName(own_rows)


def _blocks(df: DataFrame, spec: SeriesSpec, size: int, lookback: int) -> DataFrame:
    """Rows with their block number; the tail of each block is repeated in the next."""
    size = max(size, lookback)
    numbered = _row_numbers(df, spec)
    block = F.expr(f"__row div {size}")
    repeats = F.when(
        F.col("__row") % size >= size - lookback, F.array(block, block + 1)
    ).otherwise(F.array(block))
    return (
        numbered.withColumn("__blocks", repeats)
        .withColumn("__block", F.explode("__blocks"))
        .withColumn("__halo", F.col("__block") != block)
        .drop("__blocks", "__row")
    )


def _row_numbers(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Position of each row in its series from 0, without a window over the series.

    A global sort ranges over the full order, so it splits a long series between tasks.
    The position is the row's place in its task plus the rows in the tasks before.
    """
    ordered = df.orderBy(*spec.keys, spec.time, *spec.tiebreak)
    stored = checkpoint_table(
        ordered.withColumn("__id", F.monotonically_increasing_id()), "ordered-series"
    ).withColumn("__task", F.shiftright("__id", 33))
    runs = stored.groupBy(*spec.keys, "__task").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__length")
    )
    before = Window.partitionBy(*spec.keys).orderBy("__task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.withColumn("__before", F.coalesce(F.sum("__length").over(before), F.lit(0)))
    placed = attach(stored, runs.drop("__length"), (*spec.keys, "__task"))
    row = F.col("__before") + F.col("__id") - F.col("__first")
    return placed.withColumn("__row", row).drop("__id", "__task", "__first", "__before")
