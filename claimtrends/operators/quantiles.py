"""Quantiles per group, or of the whole table, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_table
from .joins import attach

ACCURACY = 10_000
# Ten times the rank error of the sketch.
MARGIN = 0.001
SMALL_GROUP = 10_000


def approx_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str]
) -> DataFrame:
    """One row per group. Sketches combine on the map side and have a bounded size."""
    names, points = list(quantiles), list(quantiles.values())
    sketch = F.percentile_approx(value, points, ACCURACY).alias("__q")
    return df.groupBy(*by).agg(sketch).select(
        *by, *[F.col("__q")[i].alias(name) for i, name in enumerate(names)]
    )


def _brackets(known: DataFrame, value: str, quantiles: list[float], by: tuple[str, ...]) -> DataFrame:
    """Size of each group, and for each quantile two values that enclose its rank."""
    edges = [e for q in quantiles for e in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))]
    found = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx(value, edges, ACCURACY).alias("__edges"),
        F.min(value).alias("__min"),
        F.max(value).alias("__max"),
    )
    # A small group is taken whole: there the sketch may be off by one row.
    small = F.col("__n") <= SMALL_GROUP
    bounds = [
        F.when(small, F.col(whole)).otherwise(F.col("__edges")[2 * i + side]).alias(f"__{name}{i}")
        for i in range(len(quantiles))
        for side, (name, whole) in enumerate((("low", "__min"), ("high", "__max")))
    ]
    return found.select(*by, "__n", *bounds)


def _with(df: DataFrame, summary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Attach a summary of the groups, or the one row of the whole table."""
    if by:
        return attach(df, summary, by)
    row = summary.select(F.struct(*summary.columns)).scalar()
    return df.withColumns({c: row[c] for c in summary.columns})


def _cumulated(steps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``__upto``: rows of the group up to each value, without a window over the group.

    A global sort spreads the values over tasks. A value's place is the sum within its part of
    the group in one task, and the sums of the group's parts in the tasks before.
    """
    ordered = steps.orderBy(*by, "__value").withColumn("__id", F.monotonically_increasing_id())
    stored = checkpoint_table(ordered, "quantile-steps").withColumn("__task", F.shiftright("__id", 33))
    parts = stored.groupBy(*by, "__task").agg(F.sum("__rows").alias("__part"))
    listed = F.array_sort(F.collect_list(F.struct("__task", "__part")))
    parts = parts.groupBy(*by).agg(listed.alias("__parts"))
    before = F.aggregate(
        F.filter("__parts", lambda p: p["__task"] < F.col("__task")), F.lit(0).cast("long"),
        lambda total, p: total + p["__part"],
    )
    within = F.sum("__rows").over(Window.partitionBy(*by, "__task").orderBy("__id"))
    return _with(stored.withColumn("__within", within), parts, by).withColumn(
        "__upto", F.col("__within") + before
    ).drop("__within", "__parts", "__id", "__task")


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    by: tuple[str, ...] = (),
    interpolate: bool = True,
) -> DataFrame:
    """Exact quantiles per group, or of the table when ``by`` is empty, one row per group.

    With ``interpolate`` one lies between the two nearest values, otherwise it is the first
    value that covers the share. One sketch brackets all wanted ranks within ``MARGIN`` of the
    group; only distinct values inside the brackets are then ordered, by a distributed sort,
    and the rows below are counted. A group of up to ``SMALL_GROUP`` rows is ordered whole.
    ``df`` is read twice.
    """
    known = df.select(*by, value).where(F.col(value).isNotNull())
    points = range(len(quantiles))
    sized = checkpoint_table(_brackets(known, value, list(quantiles.values()), by), "brackets")
    inside = [F.col(value).between(F.col(f"__low{i}"), F.col(f"__high{i}")) for i in points]
    kept = F.when(reduce(lambda a, b: a | b, inside), F.col(value)).alias("__value")
    near = _with(known, sized, by)
    below = [F.count_if(F.col(value) < F.col(f"__low{i}")).alias(f"__below{i}") for i in points]
    steps = near.groupBy(*by, kept).agg(F.count(F.lit(1)).alias("__rows"), *below)
    steps = checkpoint_table(steps, "quantile-values")
    outside = steps.where("__value is null").select(*by, *[f"__below{i}" for i in points])
    ranked = _cumulated(steps.where("__value is not null").select(*by, "__value", "__rows"), by)
    placed = _with(_with(ranked, sized, by), outside, by)
    found = []
    for i, q in enumerate(quantiles.values()):
        own = F.col("__value").between(F.col(f"__low{i}"), F.col(f"__high{i}"))
        upto = F.col("__upto") + F.coalesce(F.col(f"__below{i}"), F.lit(0))
        rank: Column = (F.col("__n") - 1) * q if interpolate else F.greatest(
            F.ceil(F.col("__n") * q) - 1, F.lit(0)).cast("double")
        found += [
            F.min(F.when(own & (upto > F.floor(rank)), F.col("__value"))).alias(f"__a{i}"),
            F.min(F.when(own & (upto > F.ceil(rank)), F.col("__value"))).alias(f"__b{i}"),
            F.min(F.when(own, upto - F.col("__rows"))).alias(f"__first{i}"),
            F.max(rank).alias(f"__rank{i}"),
        ]
    out = placed.groupBy(*by).agg(*found)
    missed = F.raise_error(F.lit("the sketch missed the wanted rank")).cast("double")
    columns = []
    for i, name in enumerate(quantiles):
        low, high, rank = F.col(f"__a{i}"), F.col(f"__b{i}"), F.col(f"__rank{i}")
        bracketed = (F.col(f"__first{i}") <= F.floor(rank)) & high.isNotNull()
        between = low + (high - low) * (rank - F.floor(rank))
        columns.append(F.when(rank.isNull(), F.lit(None)).when(bracketed, between).otherwise(missed).alias(name))
    return out.select(*by, *columns)


def exact_quantile(
    df: DataFrame, value: str, quantile: float, by: tuple[str, ...], name: str, interpolate: bool = True
) -> DataFrame:
    """``exact_quantiles`` for one."""
    return exact_quantiles(df, value, {name: quantile}, by, interpolate)
