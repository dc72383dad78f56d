"""Serving queries over the stage tables.

Each takes a table and returns one. A limit here is the query's own top-k; ties are
settled by key columns, so the rows kept do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..columns import DRUG_SERIES, SeriesSpec
from .joins import attach

KEYS = ("state", "ndc11_normalized", "product_name_fda10")

TOP_SPEND_COLUMNS = (
    *KEYS, "total_spend", "total_units", "total_scripts", "quarter_start", "risk_level",
    "risk_score",
)
TOP_RISERS_COLUMNS = (
    *KEYS, "total_spend", "qoq_spend_change", "rolling_4q_growth_spend", "cv_spend",
    "risk_level", "risk_score", "quarter_start",
)
HISTORY_COLUMNS = (
    "quarter_start", "total_spend", "total_units", "total_scripts", "qoq_spend_change",
    "rolling_4q_growth_spend", "cv_spend", "risk_level", "risk_score",
)
WATCHLIST_COLUMNS = (
    "state", "product_name_fda10", "total_spend", "risk_level", "risk_score",
    "qoq_spend_change",
)
WATCHED_LEVELS = ("high", "medium")
SALTS = 64


# Filters


def filter_states(df: DataFrame, states: Sequence[str]) -> DataFrame:
    """Rows of the listed states; an empty list keeps all."""
    return df.where(F.col("state").isin(list(states))) if states else df


def filter_quarter_range(df: DataFrame, first: date, last: date) -> DataFrame:
    return df.where(F.col("quarter_start").between(first, last))


def one_state(df: DataFrame, state: str | None) -> DataFrame:
    return df if state is None else df.where(F.col("state") == state)


def latest_quarters(df: DataFrame) -> DataFrame:
    """Latest quarter of each known state, one row per state."""
    known = df.where(F.col("state").isNotNull())
    return known.groupBy("state").agg(F.max("quarter_start").alias("latest_quarter"))


def latest_quarter_per_state(df: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Rows in the latest quarter of their own state.

    ``latest`` takes a stored ``latest_quarters`` table, so that rows need no shuffle.
    """
    out = attach(df, latest_quarters(df) if latest is None else latest, ("state",), "inner")
    return out.where(F.col("quarter_start") == F.col("latest_quarter")).drop("latest_quarter")


def latest_quarter_global(df: DataFrame) -> DataFrame:
    """Rows in the latest quarter of the whole table."""
    newest = df.agg(F.max("quarter_start").alias("q")).scalar()
    return df.where(F.col("quarter_start") == newest)


def first_rows(df: DataFrame, window: WindowSpec, k: int) -> DataFrame:
    """The first k rows of each group. Each task keeps k per group before the shuffle."""
    place = F.row_number().over(window)
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def latest_per_series(df: DataFrame, spec: SeriesSpec = DRUG_SERIES) -> DataFrame:
    """The latest row of each series."""
    return first_rows(df, spec.latest_first(), 1)


# Top lists


def _largest_first(value: str) -> list[Column]:
    return [F.col(value).desc(), *[F.col(k).asc() for k in KEYS], F.col("quarter_start").asc()]


def _top(df: DataFrame, value: str, limit: int) -> DataFrame:
    return df.orderBy(*_largest_first(value)).limit(limit)


def top_spend_latest(
    df: DataFrame, state: str | None = None, limit: int = 10, latest: DataFrame | None = None
) -> DataFrame:
    """Largest spends among rows of their state's latest quarter; one limit for all."""
    rows = latest_quarter_per_state(one_state(df, state), latest)
    return _top(rows.select(*TOP_SPEND_COLUMNS), "total_spend", limit)


def top_risers_latest(
    df: DataFrame, state: str | None = None, limit: int = 10, latest: DataFrame | None = None
) -> DataFrame:
    """Largest quarter-over-quarter rises among rows of their state's latest quarter."""
    rows = latest_quarter_per_state(one_state(df, state), latest)
    rising = rows.where(F.col("qoq_spend_change").isNotNull())
    return _top(rising.select(*TOP_RISERS_COLUMNS), "qoq_spend_change", limit)


def top_spend_latest_global(df: DataFrame, limit: int = 10) -> DataFrame:
    return _top(latest_quarter_global(df), "total_spend", limit)


def top_risers_latest_global(df: DataFrame, limit: int = 10) -> DataFrame:
    return _top(latest_quarter_global(df), "qoq_spend_change", limit)


def watchlist(
    df: DataFrame, state: str | None = None, limit: int = 20, latest_only: bool = False
) -> DataFrame:
    """High and medium risks by score, then spend, over all quarters.

    ``latest_only`` looks at the latest row of each series.
    """
    rows = latest_per_series(one_state(df, state)) if latest_only else one_state(df, state)
    watched = rows.where(F.col("risk_level").isin(*WATCHED_LEVELS)).select(*TOP_RISERS_COLUMNS)
    return watched.orderBy(F.col("risk_score").desc(), *_largest_first("total_spend")).limit(limit)


def watchlist_latest(dashboard: DataFrame, limit: int = 20) -> DataFrame:
    """The dashboard's watchlist, from ``dashboard_risks`` rows; unscored rows come last."""
    return _top(dashboard.where(F.col("risk_level").isin(*WATCHED_LEVELS)), "risk_score", limit)


def watchlist_table(df: DataFrame) -> DataFrame:
    """The columns of a watchlist that are shown."""
    return df.select(*WATCHLIST_COLUMNS)


# One series


def history_by_series(df: DataFrame, state: str, ndc11: str) -> DataFrame:
    rows = df.where((F.col("state") == state) & (F.col("ndc11_normalized") == ndc11))
    order = ("quarter_start", "product_name_fda10")
    return rows.orderBy(*order).select(*HISTORY_COLUMNS)


def history_by_product(df: DataFrame, state: str, product: str) -> DataFrame:
    rows = df.where((F.col("state") == state) & (F.col("product_name_fda10") == product))
    return rows.orderBy("quarter_start", "ndc11_normalized")


def series_tiles(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Latest change, growth and variation of every series, one row each."""
    shown = ("qoq_spend_change", "rolling_4q_growth_spend", "cv_spend")
    return latest_per_series(df, spec).select(*spec.keys, spec.time, *shown)


def history_with_forecast(history: DataFrame, forecasts: DataFrame, metric: str) -> DataFrame:
    """Observed and forecast values of each series as one long table."""
    observed = history.select(
        "state", "ndc11_normalized", "quarter_start",
        F.col(f"total_{metric}").cast("double").alias("value"),
        F.lit("historical").alias("type"),
    )
    expected = forecasts.where(F.col("error").isNull()).select(
        "state", F.col("ndc11").alias("ndc11_normalized"),
        F.col("forecast_date").alias("quarter_start"),
        F.col("forecast_value").alias("value"),
        F.lit("forecast").alias("type"),
    )
    return observed.unionByName(expected)


# Summaries


def kpi_summary(df: DataFrame) -> DataFrame:
    """Total spend, drugs, states, latest quarter and its month, in one row.

    Rows first shrink to one per state and drug, so the distinct counts are cheap.
    """
    drugs = df.groupBy("state", "ndc11_normalized").agg(
        F.sum("total_spend").alias("spend"), F.max("quarter_start").alias("latest")
    )
    return drugs.agg(
        F.sum("spend").alias("total_spend"),
        F.countDistinct("ndc11_normalized").alias("unique_drugs"),
        F.countDistinct("state").alias("states"),
        F.max("latest").alias("latest_quarter"),
        F.date_format(F.max("latest"), "yyyy-MM").alias("latest_month"),
    )


def universe_summary(df: DataFrame) -> DataFrame:
    """Numbers of states, drugs and pairs of them, quarter range and total spend."""
    drugs = df.groupBy("state", "ndc11_normalized").agg(
        F.min("quarter_start").alias("earliest"),
        F.max("quarter_start").alias("latest"),
        F.sum("total_spend").alias("spend"),
    )
    pair = F.col("state").isNotNull() & F.col("ndc11_normalized").isNotNull()
    return drugs.agg(
        F.countDistinct("state").alias("total_states"),
        F.countDistinct("ndc11_normalized").alias("total_drugs"),
        F.count_if(pair).alias("total_state_drug_combinations"),
        F.min("earliest").alias("earliest_quarter"),
        F.max("latest").alias("latest_quarter"),
        F.sum("spend").alias("total_spend_all_time"),
    )


def _risk_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("drug_count"),
        F.sum("total_spend").alias("total_spend_at_risk"),
        F.avg("risk_score").alias("avg_risk_score"),
    ]


def risk_summary(df: DataFrame) -> DataFrame:
    """Per state and level: number of rows (drug-quarters), spend and mean score."""
    return df.groupBy("state", "risk_level").agg(*_risk_totals())


def risk_summary_ordered(df: DataFrame) -> DataFrame:
    """The same with the latest quarter, by state and from high to low."""
    totals = df.groupBy("state", "risk_level").agg(
        *_risk_totals(), F.max("quarter_start").alias("latest_quarter")
    )
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("risk_level"))
    return totals.orderBy("state", rank)


def risk_level_share(df: DataFrame) -> DataFrame:
    """Rows per level over all states."""
    by_state = risk_summary(df)
    return by_state.groupBy("risk_level").agg(F.sum("drug_count").alias("drug_count"))


def risk_level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("risk_level").agg(F.count(F.lit(1)).alias("drug_count"))


def state_spend_trend(df: DataFrame, state: str | None = None) -> DataFrame:
    """Per state and quarter: spend, number of drugs and mean score."""
    totals = one_state(df, state).groupBy("state", "quarter_start").agg(
        F.sum("total_spend").alias("state_total_spend"),
        F.countDistinct("ndc11_normalized").alias("unique_drugs"),
        F.avg("risk_score").alias("avg_risk_score"),
    )
    return totals.orderBy("state", "quarter_start")


def state_comparison(df: DataFrame, measure: str = "total_spend", limit: int = 10) -> DataFrame:
    """States by the mean of a measure in the latest quarter."""
    means = latest_quarter_global(df).groupBy("state").agg(F.avg(measure).alias(measure))
    return means.orderBy(F.col(measure).desc(), "state").limit(limit)


def distinct_states(df: DataFrame) -> DataFrame:
    return df.select("state").distinct().orderBy("state")


def state_drugs(df: DataFrame, state: str) -> DataFrame:
    """Drug codes and product names seen in a state."""
    rows = df.where(F.col("state") == state)
    return rows.select("ndc11_normalized", "product_name_fda10").distinct()


def state_products(df: DataFrame, state: str) -> DataFrame:
    rows = df.where(F.col("state") == state)
    return rows.select("product_name_fda10").distinct().orderBy("product_name_fda10")


def top_per_state(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k largest rows of each state.

    Spark cuts ranks before the shuffle only up to a limit on k; beyond it the rows of a
    state are first ranked in salted parts, so that a large state is never one task.
    """
    order = [F.col(value).desc(), *[F.col(c).asc() for c in KEYS[1:]]]
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*KEYS[1:]), F.lit(SALTS)))
        parts = Window.partitionBy("state", "__salt").orderBy(*order)
        df = first_rows(salted, parts, k).drop("__salt")
    return first_rows(df, Window.partitionBy("state").orderBy(*order), k)
