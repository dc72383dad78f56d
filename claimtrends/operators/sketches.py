"""Spend thresholds from stored quantile sketches that merge.

One sketch per state and quarter is kept beside the aggregates. Sketches of disjoint rows merge, so
the thresholds of any set of quarters, or of all rows, come from the sketches alone, and a new
quarter adds sketches without reading old rows. Where rows of a quarter change, its sketch is made anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import RiskRules
from .risk import PEERS, _quantiles

#: Values a sketch holds before it starts to thin them: to that many rows it is exact.
SKETCH_SIZE = 4096
#: Rank error of a larger one as a share of its rows, with 99% confidence: 2.446 / k^0.9433, merged or not.
RANK_ERROR = 0.001


def _alive(sketch: Column) -> Column:
    """An empty sketch, of a group without a known spend, has no quantiles."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, sketch)


def spend_sketches(df: DataFrame, by: Sequence[str] = PEERS, size: int = SKETCH_SIZE) -> DataFrame:
    """One row per group: its sketch of ``total_spend`` and its number of rows.

    Unknown spends are in no sketch; a group of such rows alone has a null one.
    """
    value = F.when(~F.isnan("total_spend"), F.col("total_spend"))
    made = df.groupBy(*by).agg(
        F.kll_sketch_agg_double(value, F.lit(size)).alias("spend_sketch"), F.count(F.lit(1)).alias("rows")
    )
    return made.withColumn("spend_sketch", _alive(F.col("spend_sketch")))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = PEERS, size: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per group of sketches; their rows must be disjoint. Bounded in size, combined in each task."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("spend_sketch", F.lit(size)).alias("spend_sketch"), F.sum("rows").alias("rows")
    )
    return merged.withColumn("spend_sketch", _alive(F.col("spend_sketch")))


def thresholds_of(
    sketches: DataFrame, by: Sequence[str] = PEERS, rules: RiskRules = RiskRules()
) -> DataFrame:
    """Percentiles per group of merged sketches, null where no spend is known.

    A value is the first that covers the share, as in ``spend_thresholds``: of groups to
    SKETCH_SIZE rows exactly, of larger ones within RANK_ERROR of the rank.
    """
    return sketches.select(*by, "rows", *[
        F.kll_sketch_get_quantile_double("spend_sketch", F.lit(q)).alias(name)
        for name, q in _quantiles(rules).items()
    ])
