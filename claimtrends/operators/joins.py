"""Joining per-group summaries back to rows, and stage tables to each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, summary: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Add a summary's columns to the rows of its group; a null key is a group too.

    No broadcast is forced: the planner broadcasts the summary when its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` (known up front for a stored table, at run
    time otherwise) and else sort-merges with adaptive skew splitting.
    """
    right = summary.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return df.join(right, same, how).drop(*[f"__{k}" for k in keys])


def keep_matching(df: DataFrame, members: DataFrame, keys: tuple[str, ...], how: str = "left_semi") -> DataFrame:
    """Rows whose keys are (``left_semi``) or are not (``left_anti``) in ``members``."""
    return attach(df, members.select(*keys), keys, how)


def combined_join(aggregates: DataFrame, features: DataFrame, risks: DataFrame) -> DataFrame:
    """Join the three stage tables, for stages that do not carry each other's columns.

    The product name is one of the keys, so rows do not fan out, and only columns that
    are new come from the right.
    """
    keys = ("state", "ndc11_normalized", "product_name_fda10", "quarter_start")
    out = aggregates
    for right in (features, risks):
        new = [c for c in right.columns if c not in out.columns]
        out = attach(out, right.select(*keys, *new), keys, "inner")
    return out
