"""Parquet tables, stage boundaries, forecasts and named views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FORECAST_SCHEMA
from .session import shared_folder


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Overwrite ``path`` and tell how many rows it got, which costs no further scan.

    ``partition_by`` lets later state filters prune folders. Rows of a folder are then
    brought together first, in evenly sized parts, so that a folder has few files and a
    large one still has many writers.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return written.get["rows"]


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table at ``path``. With ``schema`` its types and column order are kept, those of
    folder columns too, which Spark would otherwise guess ('05' as the number 5)."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _stored(spark: SparkSession, path: str, schema: T.StructType, rows: int) -> DataFrame:
    """A table that knows its number of rows."""
    df = read_parquet(spark, path, schema)
    df.stored_rows = rows
    return df


def store(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to ``path`` and go on from the files, with the same types and columns."""
    return _stored(df.sparkSession, path, df.schema, write_parquet(df, path, partition_by))


def _located(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path in its terms."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _located(spark, path)
    return files.exists(target)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; build and write it first when it is not there.

    A write that did not end has no ``_SUCCESS`` and is built again.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_parquet(build(), path)
    return read_parquet(spark, path)


def checkpoint_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Compute ``df`` once into the shared folder and go on from the files.

    This cuts the lineage, survives lost executors, and gives the planner the true size:
    a small summary is broadcast in later joins and a large one is not. The files go away
    with the innermost ``stage_tables`` scope around the call, else with the application.
    """
    spark = df.sparkSession
    return store(df, new_path(spark, label))


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that goes with the scope, else with the application."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    files, target = _located(spark, path)
    files.deleteOnExit(target)
    return path


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside when the block ends.

    Results are lazy: write or collect them within the block.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files, target = _located(spark, path)
            files.delete(target, True)


def save_forecasts(forecasts: DataFrame, path: str) -> None:
    write_parquet(forecasts.select(*FORECAST_SCHEMA.names), path)


def load_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Stored forecasts, or an empty table of the same schema when there are none."""
    if path_exists(spark, path):
        return spark.read.schema(FORECAST_SCHEMA).parquet(path)
    return spark.createDataFrame([], FORECAST_SCHEMA)


def register_views(
    spark: SparkSession, aggregates: DataFrame, features: DataFrame, risks: DataFrame
) -> None:
    """Name the stage tables for SQL.

    ``risks`` holds every aggregate and feature column, so ``combined_data`` is that
    table: no join, no doubled columns, no fan-out.
    """
    views = {
        "aggregates": aggregates, "features": features, "risks": risks,
        "combined_data": risks,
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per stage with its number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("stage"), "row_count")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionByName, counts)
