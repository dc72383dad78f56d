"""The whole path from CSV files to stored stage tables and forecasts.

Claims are read once. Each stage is stored and the next one reads it, so nothing is
computed twice and a lost executor costs only its part of one stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..columns import DRUG_SERIES, PRODUCT_SERIES, RiskRules, SeriesSpec
from ..operators.aggregate import Decimals, quarterly_aggregates
from ..operators.canonical import cleanse, validate_ranges
from ..operators.features import DEFAULT_LAGS, LOOKBACK, product_trends, trend_features
from ..operators.forecast import Model, forecast_universe, run_batch_forecasts
from ..operators.long_series import MAX_ROWS, over_series
from ..operators.risk import flag_risks, spend_thresholds
from ..operators.serve import (
    filter_states,
    kpi_summary,
    latest_quarter_global,
    top_risers_latest_global,
    top_spend_latest_global,
)
from ..sources.claims_csv import read_claims
from ..sources.tables import (
    checkpoint_table,
    load_forecasts,
    read_parquet,
    register_views,
    save_forecasts,
    store,
)


@dataclass(frozen=True)
class Stages:
    """The stage tables; ``run`` also gives their row counts and, if asked, the universe."""

    aggregates: DataFrame
    features: DataFrame
    risks: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    universe: DataFrame | None = None


def quality_checked(claims: DataFrame, strict: bool = False) -> DataFrame:
    return cleanse(validate_ranges(claims, strict))


def aggregates_from_claims(claims: DataFrame, decimals: Decimals = None) -> DataFrame:
    """Canonical claims to stored quarterly aggregates, the one pass over the claims."""
    totals = quarterly_aggregates(quality_checked(claims), decimals)
    return checkpoint_table(totals, "aggregates")


def series_features(
    aggregates: DataFrame,
    lags: Sequence[int] = DEFAULT_LAGS,
    spec: SeriesSpec = DRUG_SERIES,
    max_rows: int = MAX_ROWS,
    min_prior: int = 1,
) -> DataFrame:
    """Trend features of stored aggregates, with long series spread over blocks.

    ``min_prior`` is the number of earlier quarters that growth must have, at most four.
    """
    return over_series(
        aggregates,
        spec,
        lambda df, series: trend_features(df, series, lags, min_prior),
        lookback=max(LOOKBACK, *lags) if lags else LOOKBACK,
        max_rows=max_rows,
    )


def product_features(
    aggregates: DataFrame, spec: SeriesSpec = PRODUCT_SERIES, max_rows: int = MAX_ROWS
) -> DataFrame:
    """The dashboard's features of stored aggregates."""
    return over_series(aggregates, spec, product_trends, lookback=3, max_rows=max_rows)


def risks_from_features(
    features: DataFrame, aggregates: DataFrame, rules: RiskRules = RiskRules()
) -> DataFrame:
    """Risks with thresholds taken from the stored aggregates.

    The thresholds are stored too: at the usual size they are broadcast, and the wide
    feature rows stay where the series windows left them.
    """
    thresholds = checkpoint_table(spend_thresholds(aggregates, rules), "thresholds")
    return flag_risks(features, thresholds=thresholds, rules=rules)


def stages_from_claims(
    claims: DataFrame, decimals: Decimals = None, lags: Sequence[int] = DEFAULT_LAGS
) -> Stages:
    """All stages of a query: aggregates stored, the others planned on top of them."""
    aggregates = aggregates_from_claims(claims, decimals)
    features = series_features(aggregates, lags)
    return Stages(aggregates, features, risks_from_features(features, aggregates))


def run(
    spark: SparkSession,
    raw_folder: str,
    out_folder: str,
    decimals: Decimals = None,
    lags: Sequence[int] = DEFAULT_LAGS,
    strict: bool = False,
    uniform_headers: bool = False,
    by_state: bool = True,
    rules: RiskRules = RiskRules(),
    min_prior: int = 1,
    partition_by: tuple[str, ...] = (),
    universe_k: int | None = None,
) -> Stages:
    """CSV folder to three stored tables and their SQL views.

    ``partition_by`` lays the tables out in folders, ``("state",)`` for one that one-state
    queries prune. ``universe_k`` also picks the k largest series of each state. Counts of
    claims before and after cleansing and of the stages come with the writes.
    """
    paths = {name: f"{out_folder}/{name}.parquet" for name in ("aggregates", "features", "risks")}
    raw, clean = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    claims = read_claims(spark, raw_folder, uniform_headers).observe(raw, rows)
    checked = quality_checked(claims, strict).observe(clean, rows)
    aggregates = store(quarterly_aggregates(checked, decimals), paths["aggregates"], partition_by)
    made = series_features(aggregates, lags, min_prior=min_prior)
    features = store(made, paths["features"], partition_by)
    if by_state:
        risks = risks_from_features(features, aggregates, rules)
    else:
        risks = flag_risks(features, by_state=False, rules=rules)
    risks = store(risks, paths["risks"], partition_by)

    register_views(spark, aggregates, features, risks)
    if aggregates.stored_rows:
        counts = {"raw": raw.get["rows"], "cleansed": clean.get["rows"]}
    else:  # a plan that turns out empty at run time drops what it observes
        counts = {"raw": read_claims(spark, raw_folder, uniform_headers).count(), "cleansed": 0}
    counts |= {n: t.stored_rows for n, t in (("aggregates", aggregates), ("features", features), ("risks", risks))}
    universe = None
    if universe_k is not None:
        universe = checkpoint_table(forecast_universe(features, universe_k), "universe")
    return Stages(aggregates, features, risks, counts, universe)


@dataclass(frozen=True)
class Dashboard:
    """What the dashboard shows of the chosen states."""

    summary: DataFrame
    latest: DataFrame
    top_spend: DataFrame
    top_risers: DataFrame


def dashboard(trends: DataFrame, states: Sequence[str] = (), limit: int = 10) -> Dashboard:
    """Choose states first; the latest quarter is then that of the chosen rows."""
    chosen = filter_states(trends, states)
    return Dashboard(
        kpi_summary(chosen), latest_quarter_global(chosen),
        top_spend_latest_global(chosen, limit), top_risers_latest_global(chosen, limit),
    )


def forecast(
    spark: SparkSession,
    out_folder: str,
    metric: str = "spend",
    top_k: int = 50,
    model: Model | None = None,
) -> DataFrame:
    """Forecast the largest series of the stored features and store the result."""
    features = read_parquet(spark, f"{out_folder}/features.parquet")
    universe = checkpoint_table(forecast_universe(features, top_k, metric), "universe")
    path = f"{out_folder}/forecasts_{metric}.parquet"
    save_forecasts(run_batch_forecasts(features, universe, metric, model), path)
    return load_forecasts(spark, path)
