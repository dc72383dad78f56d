"""Stage tables laid out by series, so that windows and joins of them move no rows.

A table is bucketed on ``series_id``, a hash of its series keys that is never null, and sorted
within a bucket. Windows over a series and joins on keys that start with it then find their rows
where they lie, and one series is read from one file. Series above ``max_rows`` rows would make
their bucket a task of any size: they are kept in a table of their own, evenly spread.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import AGGREGATE_KEYS, DRUG_SERIES, SeriesSpec
from ..operators.features import DEFAULT_LAGS, trend_features
from ..operators.joins import attach, keep_matching
from ..operators.long_series import MAX_ROWS
from ..operators.serve import history_by_series
from ..sources.tables import checkpoint_table, new_path
from .pipeline import series_features

SERIES_ID = "series_id"
#: Rows a bucket is meant to have.
BUCKET_ROWS = 2_000_000
#: Joins on more keys than the table is bucketed on stay in place only without this setting.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class SeriesTable:
    """``usual`` is bucketed by series; ``long`` holds the series too long for a bucket, if any."""

    usual: DataFrame
    long: DataFrame | None
    buckets: int
    spec: SeriesSpec = DRUG_SERIES
    max_rows: int = MAX_ROWS

    def rows(self) -> DataFrame:
        """The whole table, without the column that lays it out."""
        usual = self.usual.drop(SERIES_ID)
        return usual if self.long is None else usual.unionByName(self.long)


def keep_in_place(spark: SparkSession) -> SparkSession:
    """Let this session join bucketed tables on more keys than they are bucketed on without exchange.

    A setting of the session: other joins may then also use a partitioning on some of their keys.
    """
    spark.conf.set(ALL_KEYS, "false")
    return spark


def series_id(*keys: Column) -> Column:
    """Where a series lies. Null keys have a place too; equal ids are not yet equal keys."""
    return F.xxhash64(*keys)


def bucket_count(rows: int) -> int:
    """A power of two, so that tables of different sizes still fit each other."""
    return 1 << max(2, (max(rows, 1) // BUCKET_ROWS).bit_length())


def _write_buckets(df: DataFrame, spec: SeriesSpec, buckets: int, label: str) -> DataFrame:
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    order = (SERIES_ID, *spec.keys, spec.time, *spec.tiebreak)
    (df.write.mode("overwrite").bucketBy(buckets, SERIES_ID).sortBy(*order)
     .option(f"parquet.bloom.filter.enabled#{SERIES_ID}", "true")
     .option("path", new_path(spark, label)).saveAsTable(name))
    return spark.table(name)


def store_by_series(
    df: DataFrame,
    label: str,
    spec: SeriesSpec = DRUG_SERIES,
    buckets: int | None = None,
    max_rows: int = MAX_ROWS,
) -> SeriesTable:
    """Store a table by series, with one exchange. ``df`` is read three times unless it is small.

    A null key is a value like any other. An empty table has empty buckets. A column named
    ``series_id`` is an error, as the layout needs the name.
    """
    if SERIES_ID in df.columns:
        raise ValueError(f"the table has a column {SERIES_ID} of its own")
    rows = getattr(df, "stored_rows", None)
    if rows is None:
        df = checkpoint_table(df, label)
        rows = df.stored_rows
    long = None
    if rows > max_rows:
        sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("rows"))
        keys = checkpoint_table(sizes.where(F.col("rows") > max_rows).select(*spec.keys), "long-series")
        if keys.stored_rows:
            long = checkpoint_table(keep_matching(df, keys, spec.keys, "left_semi"), f"{label}-long")
            df = keep_matching(df, keys, spec.keys, "left_anti")
    buckets = buckets or bucket_count(rows)
    placed = df.withColumn(SERIES_ID, series_id(*spec.keys)).repartition(buckets, SERIES_ID)
    return SeriesTable(_write_buckets(placed, spec, buckets, label), long, buckets, spec, max_rows)


def store_in_place(usual: DataFrame, long: DataFrame | None, like: SeriesTable, label: str) -> SeriesTable:
    """Store what was computed bucket by bucket from ``like``: the rows are written where they are."""
    stored = _write_buckets(usual, like.spec, like.buckets, label)
    kept = None if long is None else checkpoint_table(long, f"{label}-long")
    return replace(like, usual=stored, long=kept)


def features_by_series(
    aggregates: SeriesTable, lags: Sequence[int] = DEFAULT_LAGS, min_prior: int = 1
) -> tuple[DataFrame, DataFrame | None]:
    """``trend_features`` of a stored table: of its buckets, without an exchange, and of its long series.

    The first frame keeps ``series_id``, so ``store_in_place`` takes both as they are.
    """
    spec = aggregates.spec
    placed = replace(spec, keys=(SERIES_ID, *spec.keys))
    usual = trend_features(aggregates.usual, placed, lags, min_prior)
    if aggregates.long is None:
        return usual, None
    return usual, series_features(aggregates.long, lags, spec, aggregates.max_rows, min_prior)


def combined_by_series(aggregates: SeriesTable, *others: SeriesTable) -> DataFrame:
    """``combined_join`` of tables stored alike, without an exchange after ``keep_in_place``.

    Rows are matched on the four keys of a row, nulls included; from the right come new columns only.
    """
    if any(t.buckets != aggregates.buckets or (t.long is None) != (aggregates.long is None) for t in others):
        raise ValueError("the tables are not stored alike")
    out = aggregates.usual
    for right in others:
        new = [c for c in right.usual.columns if c not in out.columns]
        right = right.usual.select(SERIES_ID, *AGGREGATE_KEYS, *new).withColumnRenamed(SERIES_ID, "__id")
        # plainly equal ids keep the buckets; null-safe ones would be compared as expressions
        matched = right.withColumnsRenamed({k: f"__{k}" for k in AGGREGATE_KEYS})
        same = F.col(SERIES_ID) == F.col("__id")
        for k in AGGREGATE_KEYS:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.join(matched.hint("merge"), same).drop("__id", *[f"__{k}" for k in AGGREGATE_KEYS])
    out = out.drop(SERIES_ID)
    if aggregates.long is None:
        return out
    long = aggregates.long
    for right in others:
        new = [c for c in right.long.columns if c not in long.columns]
        long = attach(long, right.long.select(*AGGREGATE_KEYS, *new), AGGREGATE_KEYS, "inner")
    return out.unionByName(long)


def history_in_place(table: SeriesTable, state: str, ndc11: str) -> DataFrame:
    """``history_by_series`` from the one bucket that may hold it, by its sorted row groups."""
    mine = F.col(SERIES_ID) == series_id(F.lit(state), F.lit(ndc11))
    rows = table.usual.where(mine).drop(SERIES_ID)
    if table.long is not None:
        rows = rows.unionByName(table.long)
    return history_by_series(rows, state, ndc11)
