"""One registered query per operator. Each reads the tables whole and does its own work."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrends.columns import DRUG_SERIES, PRODUCT_SERIES
from claimtrends.functions import round_to
from claimtrends.operators import aggregate, bitmaps, canonical, changepoints, features, forecast, risk, serve, sketches
from claimtrends.operators.joins import combined_join
from claimtrends.operators.long_series import over_series
from claimtrends.plans import by_series
from claimtrends.plans import (
    Stages,
    aggregates_from_claims,
    dashboard,
    product_features,
    quality_checked,
    refresh,
    run,
    series_features,
    stages_from_claims,
)
from claimtrends.sources import (
    Store,
    checkpoint_table,
    export_csv,
    load_forecasts,
    materialize,
    new_path,
    read_checked_claims,
    read_claims,
    read_raw_csvs,
    register_functions,
    register_views,
    save_forecasts,
    shared_folder,
    stage_counts,
    store,
    use_folder,
)

from . import claims as source

Query = Callable[[SparkSession, str], DataFrame]

CENTS = 2
# The messy claims have amounts in tenths of a cent.
MILLS = 3
STATE = "05"
STATES = ("03", "05", "11")
DRUG = "00000000013"
PRODUCT = "PROMO"
TOP_K = 10
METRIC = "spend"

QUERIES: dict[str, Query] = {}

# Decimals shown, by the ending of a column name; other columns are left as they are.
SHOWN = (
    ("_std", 3), ("_avg", 4), ("_change", 6), ("_share", 6), ("_per_script", 6),
    ("_per_unit", 6), ("cv_spend", 6), ("cv_units", 6), ("cv_scripts", 6),
    ("growth_spend", 6), ("growth_units", 6), ("avg_risk_score", 6),
    ("total_spend_at_risk", 2), ("state_total_spend", 2), ("total_spend_all_time", 2),
    ("forecast_value", 2), ("forecast_lower", 2), ("forecast_upper", 2), ("spend_cut", 4),
)


def shown(df: DataFrame, **digits: int) -> DataFrame:
    """Round derived doubles so that engines that add in another order agree."""
    rules = (*digits.items(), *SHOWN)
    rounded = {}
    for field in df.schema:
        match = next((d for end, d in rules if field.name.endswith(end)), None)
        if match is not None and field.dataType.typeName() == "double":
            rounded[field.name] = round_to(F.col(field.name), match)
    return df.withColumns(rounded)


def _with_folder(spark: SparkSession) -> SparkSession:
    """A local session without a shared folder keeps intermediate tables beside its tables.

    On a cluster that would be a folder of each machine, so there the missing setting is an error.
    """
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return use_folder(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages")
    shared_folder(spark)
    return spark


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under a name."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: fn(_with_folder(spark), folder)
        return fn

    return register


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates for a query that reads them once: filters and columns reach the tables."""
    return aggregate.quarterly_aggregates(quality_checked(source.claims(spark, folder)), CENTS)


def _aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates for a query that reads them more than once: computed once and stored."""
    return aggregates_from_claims(source.claims(spark, folder), CENTS)


def _stages(spark: SparkSession, folder: str, state: str | None = None) -> Stages:
    """All stages. Series and peers lie within a state, so one state can be cut out first."""
    rows = serve.one_state(source.claims(spark, folder), state)
    return stages_from_claims(rows, CENTS)


def _risks(spark: SparkSession, folder: str, state: str | None = None) -> DataFrame:
    return _stages(spark, folder, state).risks


def _per_series(spark: SparkSession, folder: str, transform, spec=DRUG_SERIES) -> DataFrame:
    lookback = features.LOOKBACK
    return over_series(_aggregates(spark, folder), spec, transform, lookback)


def _dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """Latest-quarter rows with the dashboard's features, stored as they are read twice."""
    trends = product_features(_aggregates(spark, folder))
    return checkpoint_table(serve.latest_quarter_global(trends), "latest")


# Sources and sinks

CLAIM_COLUMNS = (
    *source.HEADERS, "quarter_start", "ndc11_normalized", "spend_mismatch",
)


@query("scan_csv")
def scan_csv_query(spark, folder):
    path = new_path(spark, "claims-csv")
    export_csv(source.raw_claims(spark, folder), path)
    return read_claims(spark, path).select(*CLAIM_COLUMNS)


@query("union_by_name")
def union_by_name_query(spark, folder):
    """Two extracts in one folder: other column order, and one column less."""
    path = new_path(spark, "two-extracts")
    raw = source.raw_claims(spark, folder)
    before = F.coalesce(F.col("Year") < 1999, F.lit(False))
    early = raw.where(before).select(*reversed(raw.columns))
    late = raw.where(~before).drop("Suppression Used")
    export_csv(early, path)
    late.write.mode("append").option("header", True).csv(path)
    return read_raw_csvs(spark, path).select(*source.HEADERS.values())


@query("scan_quarantine")
def scan_quarantine_query(spark, folder):
    """Every record of an extract with broken ones, kept or quarantined."""
    path = new_path(spark, "broken-csv")
    source.export_with_broken_records(spark, folder, path)
    checked = read_checked_claims(spark, path)
    names = ("state", "ndc11_normalized", "product_name_fda10", "quarter_start", "units_reimbursed", "total_amount")
    kept = checked.claims.select(F.lit(None).cast("string").alias("raw"), *names)
    broken = checked.quarantine.select("raw", *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in names])
    return kept.unionByName(broken)


@query("parquet_roundtrip")
def parquet_roundtrip_query(spark, folder):
    """One folder per state; a state such as '05' stays text."""
    totals = aggregate.quarterly_aggregates(source.claims(spark, folder), CENTS)
    return shown(store(totals, new_path(spark, "aggregates"), partition_by=("state",)))


@query("materialize")
def materialize_query(spark, folder):
    """The second call reads what the first one wrote."""
    path = new_path(spark, "materialized")
    build = lambda: aggregate.quarterly_aggregates(source.claims(spark, folder), CENTS)
    materialize(spark, path, build)
    return shown(materialize(spark, path, build))


@query("load_or_empty")
def load_or_empty_query(spark, folder):
    """Stored forecasts, and nothing from a path that was never written."""
    path = new_path(spark, "forecasts")
    save_forecasts(_batch(spark, folder), path)
    absent = load_forecasts(spark, f"{path}-absent")
    return shown(load_forecasts(spark, path).unionByName(absent))


@query("export_csv")
def export_csv_query(spark, folder):
    path = new_path(spark, "watchlist-csv")
    export_csv(serve.watchlist(_risks(spark, folder)), path)
    text = spark.read.option("header", True).csv(path)
    return text.select(
        "state", "ndc11_normalized", "product_name_fda10", "risk_level",
        F.col("risk_score").try_cast("int").alias("risk_score"),
        F.col("quarter_start").try_cast("date").alias("quarter_start"),
    )


@query("combined_view")
def combined_view_query(spark, folder):
    stages = _stages(spark, folder)
    register_views(spark, stages.aggregates, stages.features, stages.risks)
    return shown(spark.sql(
        "SELECT state, ndc11_normalized, product_name_fda10, quarter_start, total_spend,"
        " qoq_spend_change, cv_spend, risk_level, risk_score FROM combined_data"
    ))


@query("stage_counts")
def stage_counts_query(spark, folder):
    """Two passes over the claims: one that counts them, one that stores the aggregates."""
    checked = canonical.validate_ranges(_canonical(spark, folder))
    totals = aggregate.quarterly_totals(canonical.cleanse(checked), MILLS)
    stored = checkpoint_table(totals, "aggregates")
    return canonical.cleansing_counts(checked).unionByName(stage_counts({"aggregates": stored}))


# Projections


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    raw = source.messy_claims(spark, folder)
    return canonical.apply_schema(raw, canonical.detect_columns(raw.columns))


@query("canonicalize")
def canonicalize_query(spark, folder):
    return _canonical(spark, folder)


@query("quarter_start")
def quarter_start_query(spark, folder):
    rows = _canonical(spark, folder).groupBy("year", "quarter", "quarter_start")
    return rows.agg(F.count(F.lit(1)).alias("claims"))


@query("normalize_ndc")
def normalize_ndc_query(spark, folder):
    rows = _canonical(spark, folder).groupBy("ndc11", "ndc11_normalized")
    return rows.agg(F.count(F.lit(1)).alias("claims"))


@query("spend_mismatch")
def spend_mismatch_query(spark, folder):
    columns = ("total_amount", "medicaid_amount", "non_medicaid_amount", "spend_mismatch")
    return _canonical(spark, folder).select(*columns)


@query("validate")
def validate_query(spark, folder):
    return canonical.validate_ranges(_canonical(spark, folder))


@query("cleanse")
def cleanse_query(spark, folder):
    return quality_checked(_canonical(spark, folder))


@query("nonnegative_measures")
def nonnegative_measures_query(spark, folder):
    net = source.claims(spark, folder).groupBy("state", "ndc11_normalized", "quarter_start").agg(
        F.sum((F.col("total_amount") - 30_000).cast("decimal(18,2)")).cast("double").alias("total_spend"),
        F.sum("prescriptions").alias("total_scripts"),
    )
    return canonical.nonnegative_measures(net)


@query("quarterly_aggregates")
def quarterly_aggregates_query(spark, folder):
    return shown(aggregate.quarterly_aggregates(source.claims(spark, folder), CENTS))


@query("safe_ratios")
def safe_ratios_query(spark, folder):
    totals = aggregate.quarterly_totals(quality_checked(_canonical(spark, folder)), MILLS)
    return shown(aggregate.safe_ratios(totals))


@query("safe_ratios_zero")
def safe_ratios_zero_query(spark, folder):
    totals = aggregate.quarterly_totals(quality_checked(_canonical(spark, folder)), MILLS)
    return aggregate.safe_ratios_zero(totals)


@query("time_dimensions")
def time_dimensions_query(spark, folder):
    totals = aggregate.quarterly_totals(source.claims(spark, folder), CENTS)
    return canonical.time_dimensions(totals)


@query("quarterly_aggregates_by_state")
def quarterly_aggregates_by_state_query(spark, folder):
    """The rows of a state brought together, a large state in several parts."""
    return shown(aggregate.quarterly_aggregates(source.claims(spark, folder), CENTS, by_state=True))


@query("quarterly_units_fractional")
def quarterly_units_fractional_query(spark, folder):
    """Units in eighths: their decimals are their own, not those of the amounts."""
    eighths = source.claims(spark, folder).withColumn("units_reimbursed", F.col("units_reimbursed") / 8)
    known = dict.fromkeys(aggregate.AMOUNTS, CENTS) | {"units_reimbursed": 3}
    return aggregate.quarterly_totals(eighths, known)


# Features


@query("trend_features_in_blocks")
def trend_features_in_blocks_query(spark, folder):
    """Series of more than twenty rows are computed block by block, with the same values."""
    return shown(series_features(_aggregates(spark, folder), lags=(), max_rows=20))


@query("qoq_change")
def qoq_change_query(spark, folder):
    return shown(_per_series(spark, folder, features.qoq_change)).drop(*RATIOS)


@query("rolling_stats")
def rolling_stats_query(spark, folder):
    return shown(_per_series(spark, folder, features.rolling_stats)).drop(*RATIOS)


@query("cv")
def cv_query(spark, folder):
    return shown(_per_series(spark, folder, features.variation)).drop(*RATIOS)


@query("rolling_growth")
def rolling_growth_query(spark, folder):
    return shown(_per_series(spark, folder, features.rolling_growth)).drop(*RATIOS)


@query("trend_direction")
def trend_direction_query(spark, folder):
    return shown(_per_series(spark, folder, features.trend_direction)).drop(*RATIOS)


@query("lag_features")
def lag_features_query(spark, folder):
    return _per_series(spark, folder, features.lag_features).drop(*RATIOS)


@query("trend_features")
def trend_features_query(spark, folder):
    return shown(series_features(_aggregates(spark, folder), lags=()))


@query("calendar_features")
def calendar_features_query(spark, folder):
    """Series with gaps: one code per part, and frames that count quarters."""
    aggregates = aggregates_from_claims(source.claims(spark, folder, sparse=True), CENTS)
    lags = {f"_lag_{k}q": 2 for k in features.DEFAULT_LAGS}
    return shown(features.calendar_features(aggregates), **lags).drop(*RATIOS)


@query("latest_per_series")
def latest_per_series_query(spark, folder):
    return shown(serve.latest_per_series(_planned(spark, folder)))


@query("qoq_change_by_product")
def qoq_change_by_product_query(spark, folder):
    rows = _per_series(spark, folder, features.qoq_change_by_product, PRODUCT_SERIES)
    return shown(rows).drop(*RATIOS)


@query("rolling_stats_by_product")
def rolling_stats_by_product_query(spark, folder):
    rows = _per_series(spark, folder, features.rolling_stats_by_product, PRODUCT_SERIES)
    return shown(rows).drop(*RATIOS)


@query("endpoint_growth")
def endpoint_growth_query(spark, folder):
    rows = _per_series(spark, folder, features.endpoint_growth, PRODUCT_SERIES)
    return shown(rows).drop(*RATIOS)


@query("series_tiles")
def series_tiles_query(spark, folder):
    trends = product_features(_aggregates(spark, folder))
    return shown(serve.series_tiles(trends, PRODUCT_SERIES))


RATIOS = ("spend_per_script", "spend_per_unit", "medicaid_share")

# Risk


@query("spend_percentiles")
def spend_percentiles_query(spark, folder):
    aggregates = _aggregates(spark, folder)
    thresholds = checkpoint_table(risk.spend_thresholds(aggregates), "thresholds")
    return risk.spend_percentiles(aggregates, thresholds).drop(*RATIOS)


@query("spend_percentiles_global")
def spend_percentiles_global_query(spark, folder):
    return risk.spend_percentiles_global(_aggregates(spark, folder)).drop(*RATIOS)


FLAGS = (
    "high_cost", "very_high_cost", "high_vol", "extreme_vol", "fast_riser", "extreme_riser",
    "declining", "rapid_decline",
)
ROW = ("state", "ndc11_normalized", "product_name_fda10", "quarter_start")


@query("risk_flags")
def risk_flags_query(spark, folder):
    return _risks(spark, folder).select(*ROW, *FLAGS)


@query("risk_level")
def risk_level_query(spark, folder):
    return _risks(spark, folder).select(*ROW, "risk_level")


@query("risk_score")
def risk_score_query(spark, folder):
    return _risks(spark, folder).select(*ROW, "risk_level", "risk_score")


@query("flag_risks")
def flag_risks_query(spark, folder):
    """Thresholds over the whole table instead of state and quarter."""
    trends = series_features(_aggregates(spark, folder), lags=())
    return risk.flag_risks(trends, by_state=False).select(
        *ROW, "spend_75th_percentile", "spend_90th_percentile", *FLAGS, "risk_level", "risk_score"
    )


@query("pipeline_risks")
def pipeline_risks_query(spark, folder):
    return shown(_risks(spark, folder))


@query("pipeline_from_csv")
def pipeline_from_csv_query(spark, folder):
    """The whole path: CSV extract in, three stored tables and their views out."""
    path = new_path(spark, "pipeline")
    export_csv(source.raw_claims(spark, folder), f"{path}/raw")
    return shown(run(spark, f"{path}/raw", f"{path}/processed", CENTS).risks)


@query("pipeline_incremental")
def pipeline_incremental_query(spark, folder):
    """Three extracts taken in one after the other, late claims of old quarters in the last two."""
    path = new_path(spark, "incremental")
    rows = source.raw_claims(spark, folder)
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(20))
    year = F.coalesce(F.col("Year").try_cast("int"), F.lit(0))
    batch = F.when(late == 0, 3).when((late == 1) | ((year >= 1998) & (year < 2001)), 2).when(year >= 2001, 3).otherwise(1)
    source.export_batches(rows, batch, f"{path}/batches")
    for number in (1, 2, 3):
        source.deliver_batch(rows, f"{path}/batches", number, f"{path}/raw")
        stages = refresh(spark, f"{path}/raw", f"{path}/store", CENTS)
    return shown(stages.risks)


@query("snapshot_read")
def snapshot_read_query(spark, folder):
    """Two versions of a table, and a build that fails and leaves both as they were."""
    store = Store(spark, new_path(spark, "snapshots"))
    totals = _aggregates(spark, folder)
    first = store.replace("aggregates", totals.where(F.year("quarter_start") < 1999), ("quarter_start",))
    store.replace("aggregates", totals)
    broken = totals.withColumn("total_spend", F.raise_error(F.lit("a build that fails")).cast("double"))
    try:
        store.replace("aggregates", broken)
    except Exception as error:  # noqa: BLE001 - whatever Spark makes of it
        if "a build that fails" not in str(error):
            raise
    versions = [(1, store.read("aggregates", first)), (2, store.read("aggregates"))]
    old, new = (df.select(F.lit(n).alias("version"), "*") for n, df in versions)
    return shown(old.unionByName(new))


@query("high_cost_exact")
def high_cost_exact_query(spark, folder):
    rows = risk.high_cost_exact(_dashboard(spark, folder))
    return shown(rows.select(*ROW, "total_spend", "spend_cut", "high_cost"))


@query("demo_risk")
def demo_risk_query(spark, folder):
    return shown(risk.dashboard_risks(_dashboard(spark, folder)))


# Serving


@query("filter_states")
def filter_states_query(spark, folder):
    return shown(serve.filter_states(_planned(spark, folder), STATES))


@query("filter_quarter_range")
def filter_quarter_range_query(spark, folder):
    rows = _planned(spark, folder)
    return shown(serve.filter_quarter_range(rows, date(1997, 1, 1), date(1999, 12, 31)))


@query("history_by_series")
def history_by_series_query(spark, folder):
    return shown(serve.history_by_series(_risks(spark, folder, STATE), STATE, DRUG))


def _latest(df: DataFrame) -> DataFrame:
    return checkpoint_table(serve.latest_quarters(df), "latest-quarters")


@query("history_by_product")
def history_by_product_query(spark, folder):
    trends = product_features(_aggregates(spark, folder))
    return shown(serve.history_by_product(trends, STATE, PRODUCT))


@query("top_spend_latest")
def top_spend_latest_query(spark, folder):
    stages = _stages(spark, folder)
    return shown(serve.top_spend_latest(stages.risks, latest=_latest(stages.aggregates)))


@query("top_spend_latest_state")
def top_spend_latest_state_query(spark, folder):
    stages = _stages(spark, folder, STATE)
    return shown(serve.top_spend_latest(stages.risks, STATE, latest=_latest(stages.aggregates)))


@query("top_risers_latest")
def top_risers_latest_query(spark, folder):
    stages = _stages(spark, folder)
    return shown(serve.top_risers_latest(stages.risks, latest=_latest(stages.aggregates)))


@query("top_risers_latest_state")
def top_risers_latest_state_query(spark, folder):
    stages = _stages(spark, folder, STATE)
    return shown(serve.top_risers_latest(stages.risks, STATE, latest=_latest(stages.aggregates)))


@query("latest_quarter_global")
def latest_quarter_global_query(spark, folder):
    return shown(serve.latest_quarter_global(_aggregates(spark, folder)))


@query("top_spend_latest_global")
def top_spend_latest_global_query(spark, folder):
    return shown(serve.top_spend_latest_global(_aggregates(spark, folder)))


@query("top_risers_latest_global")
def top_risers_latest_global_query(spark, folder):
    return shown(serve.top_risers_latest_global(product_features(_aggregates(spark, folder))))


@query("watchlist")
def watchlist_query(spark, folder):
    return shown(serve.watchlist(_risks(spark, folder)))


@query("watchlist_state")
def watchlist_state_query(spark, folder):
    return shown(serve.watchlist(_risks(spark, folder, STATE), STATE))


@query("watchlist_latest")
def watchlist_latest_query(spark, folder):
    rows = risk.dashboard_risks(_dashboard(spark, folder))
    return shown(serve.watchlist_table(serve.watchlist_latest(rows)))


@query("combined_join")
def combined_join_query(spark, folder):
    stages = _stages(spark, folder)
    return shown(combined_join(stages.aggregates, stages.features, stages.risks).drop(*RATIOS))


@query("kpi_summary")
def kpi_summary_query(spark, folder):
    return shown(serve.kpi_summary(_planned(spark, folder)), total_spend=2)


@query("risk_summary")
def risk_summary_query(spark, folder):
    return shown(serve.risk_summary(_risks(spark, folder)))


@query("risk_summary_ordered")
def risk_summary_ordered_query(spark, folder):
    return shown(serve.risk_summary_ordered(_risks(spark, folder)))


@query("risk_level_share")
def risk_level_share_query(spark, folder):
    return serve.risk_level_share(_risks(spark, folder))


@query("risk_level_counts")
def risk_level_counts_query(spark, folder):
    return serve.risk_level_counts(risk.dashboard_risks(_dashboard(spark, folder)))


@query("state_spend_trend")
def state_spend_trend_query(spark, folder):
    return shown(serve.state_spend_trend(_risks(spark, folder)))


@query("state_spend_trend_state")
def state_spend_trend_state_query(spark, folder):
    return shown(serve.state_spend_trend(_risks(spark, folder, STATE), STATE))


@query("state_comparison")
def state_comparison_query(spark, folder):
    return shown(serve.state_comparison(_aggregates(spark, folder), "total_spend"), total_spend=4)


@query("state_comparison_units")
def state_comparison_units_query(spark, folder):
    return shown(serve.state_comparison(_aggregates(spark, folder), "total_units"), total_units=4)


@query("dashboard_filtered")
def dashboard_filtered_query(spark, folder):
    """Chosen states first, then the latest quarter of what is left."""
    trends = product_features(_aggregates(spark, folder))
    rows = dashboard(trends, STATES, TOP_K).top_spend
    return shown(rows)


@query("universe_summary")
def universe_summary_query(spark, folder):
    return shown(serve.universe_summary(_planned(spark, folder)))


@query("distinct_states")
def distinct_states_query(spark, folder):
    return serve.distinct_states(_planned(spark, folder))


@query("state_drugs")
def state_drugs_query(spark, folder):
    return serve.state_drugs(_planned(spark, folder), STATE)


@query("state_products")
def state_products_query(spark, folder):
    return serve.state_products(_planned(spark, folder), STATE)


# Stored layouts


def _by_series(spark: SparkSession, folder: str) -> by_series.SeriesTable:
    return by_series.store_by_series(_aggregates(spark, folder), "series_aggregates")


def _stages_by_series(spark: SparkSession, folder: str) -> tuple[by_series.SeriesTable, ...]:
    """The three stage tables in buckets; the later two are written where the first one lies."""
    aggregates = _by_series(spark, folder)
    made = by_series.store_in_place(*by_series.features_by_series(aggregates), aggregates, "series_features")
    thresholds = checkpoint_table(risk.spend_thresholds(aggregates.rows()), "thresholds")
    graded = [None if t is None else risk.flag_risks(t, thresholds=thresholds) for t in (made.usual, made.long)]
    return aggregates, made, by_series.store_in_place(*graded, aggregates, "series_risks")


@query("trend_features_by_series")
def trend_features_by_series_query(spark, folder):
    usual, long = by_series.features_by_series(_by_series(spark, folder), lags=())
    usual = usual.drop(by_series.SERIES_ID)
    return shown(usual if long is None else usual.unionByName(long))


@query("trend_features_long_by_series")
def trend_features_long_by_series_query(spark, folder):
    """Series of more than eight rows are kept out of the buckets."""
    table = by_series.store_by_series(_aggregates(spark, folder), "series_aggregates", max_rows=8)
    usual, long = by_series.features_by_series(table, lags=())
    return shown(usual.drop(by_series.SERIES_ID).unionByName(long))


@query("combined_join_by_series")
def combined_join_by_series_query(spark, folder):
    stages = _stages_by_series(by_series.keep_in_place(spark), folder)
    return shown(by_series.combined_by_series(*stages).drop(*RATIOS))


@query("history_in_place")
def history_in_place_query(spark, folder):
    return shown(by_series.history_in_place(_stages_by_series(spark, folder)[2], STATE, DRUG))


@query("thresholds_merged")
def thresholds_merged_query(spark, folder):
    """Thresholds of a state and year, from the stored sketches of its quarters."""
    stored = checkpoint_table(sketches.spend_sketches(_planned(spark, folder)), "sketches")
    by = ("state", "year")
    years = stored.withColumn("year", F.year("quarter_start"))
    return sketches.thresholds_of(sketches.merge_sketches(years, by), by)


NEWER = date(1996, 1, 1)
SUBSETS = {
    "all": bitmaps.Subset(),
    "three states": bitmaps.Subset(STATES),
    "newer": bitmaps.Subset(first=NEWER),
    "one state, one year": bitmaps.Subset((STATE,), date(1994, 1, 1), date(1994, 12, 31)),
    "no state": bitmaps.Subset(("none",)),
}


@query("kpi_from_bitmaps")
def kpi_from_bitmaps_query(spark, folder):
    """Cells of the older quarters are stored first; the newer ones come with codes of their own."""
    aggregates = _aggregates(spark, folder)
    older, newer = (aggregates.where(test) for test in (
        F.col("quarter_start") < F.lit(NEWER), F.col("quarter_start") >= F.lit(NEWER)))
    numbers = checkpoint_table(bitmaps.code_numbers(older), "numbers")
    cells = checkpoint_table(bitmaps.kpi_cells(older, numbers), "cells")
    numbers = checkpoint_table(bitmaps.code_numbers(newer, numbers), "numbers")
    cells = checkpoint_table(bitmaps.merge_cells(cells, bitmaps.kpi_cells(newer, numbers)), "cells")
    return shown(bitmaps.kpi_of(cells, SUBSETS), total_spend=2)


# From SQL


def _functions(spark: SparkSession, folder: str) -> SparkSession:
    risks = checkpoint_table(_risks(spark, folder), "risks")
    register_functions(spark, risks)
    return spark


@query("sql_top_spend")
def sql_top_spend_query(spark, folder):
    return shown(_functions(spark, folder).sql(f"SELECT * FROM top_spend('{STATE}', {TOP_K})"))


@query("sql_top_risers")
def sql_top_risers_query(spark, folder):
    return shown(_functions(spark, folder).sql(f"SELECT * FROM top_risers(k => {TOP_K})"))


@query("sql_watchlist")
def sql_watchlist_query(spark, folder):
    return shown(_functions(spark, folder).sql("SELECT * FROM watchlist()"))


# Forecasts


def _chosen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Aggregates and the stored universe."""
    aggregates = _aggregates(spark, folder)
    universe = forecast.forecast_universe(aggregates, TOP_K, METRIC)
    return aggregates, checkpoint_table(universe, "universe")


def _everything(aggregates: DataFrame) -> DataFrame:
    """Every series of the table as a stored universe: its keys and latest product name."""
    latest = serve.latest_per_series(aggregates)
    return checkpoint_table(latest.select(*DRUG_SERIES.keys, "product_name_fda10"), "universe")


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    aggregates, universe = _chosen(spark, folder)
    return forecast.run_batch_forecasts(aggregates, universe, METRIC)


@query("forecast_universe")
def forecast_universe_query(spark, folder):
    return shown(_chosen(spark, folder)[1])


@query("forecast_universe_units")
def forecast_universe_units_query(spark, folder):
    return shown(forecast.forecast_universe(_aggregates(spark, folder), TOP_K, "units"))


@query("forecast_short_series")
def forecast_short_series_query(spark, folder):
    """One code per part: most series are too short and say so."""
    aggregates = aggregates_from_claims(source.claims(spark, folder, sparse=True), CENTS)
    everything = _everything(aggregates)
    frame = forecast.series_frame(aggregates, everything, METRIC)
    rows = forecast.forecast_seasonal_trend(frame, everything, METRIC)
    # Few points in cents often forecast half a cent: noise of addition goes before rounding.
    return shown(shown(rows, forecast_value=8, forecast_lower=8, forecast_upper=8))


@query("forecast_input")
def forecast_input_query(spark, folder):
    return shown(forecast.forecast_input(*_chosen(spark, folder)))


@query("series_frame")
def series_frame_query(spark, folder):
    return forecast.series_frame(*_chosen(spark, folder), METRIC)


@query("forecast_seasonal_trend")
def forecast_seasonal_trend_query(spark, folder):
    """Every series of the table, not only the largest."""
    aggregates = _aggregates(spark, folder)
    everything = _everything(aggregates)
    frame = forecast.series_frame(aggregates, everything, "units")
    return shown(forecast.forecast_seasonal_trend(frame, everything, "units"))


@query("forecast_batch")
def forecast_batch_query(spark, folder):
    return shown(_batch(spark, folder))


@query("forecast_changepoint")
def forecast_changepoint_query(spark, folder):
    aggregates, universe = _chosen(spark, folder)
    frame = forecast.series_frame(aggregates, universe, METRIC)
    rows = changepoints.forecast_changepoint(frame, universe, METRIC)
    return shown(rows, forecast_value=1, forecast_lower=1, forecast_upper=1)


@query("forecast_backtest")
def forecast_backtest_query(spark, folder):
    """What every series of the table would have been forecast at each earlier quarter."""
    aggregates = _aggregates(spark, folder)
    everything = _everything(aggregates)
    rows = changepoints.backtest(forecast.series_frame(aggregates, everything, METRIC))
    return shown(rows, forecast=1, actual=4, error=1)


@query("forecast_dates")
def forecast_dates_query(spark, folder):
    return forecast.forecast_dates(_planned(spark, folder))


@query("forecast_grouped_map")
def forecast_grouped_map_query(spark, folder):
    """A model given by the user: the last value plus the mean step."""

    def drift(points: pd.DataFrame, horizon: int) -> pd.DataFrame:
        y = points["y"].to_numpy()
        step = (y[-1] - y[0]) / (len(y) - 1)
        if step < 0:
            raise ValueError("falling series")
        center = pd.Series([y[-1] + step * h for h in range(1, horizon + 1)])
        return pd.DataFrame({"yhat": center, "yhat_lower": center - step, "yhat_upper": center + step})

    aggregates, universe = _chosen(spark, folder)
    return shown(forecast.run_batch_forecasts(aggregates, universe, METRIC, model=drift))


@query("forecast_faulty_models")
def forecast_faulty_models_query(spark, folder):
    """A model that fails in another way for each code: error rows beside good forecasts."""

    def model(points: pd.DataFrame, horizon: int) -> pd.DataFrame:
        center = pd.Series([points["y"].iloc[-1]] * horizon)
        good = pd.DataFrame({"yhat": center, "yhat_lower": center, "yhat_upper": center})
        kind = len(points) % 5
        return [good, pd.DataFrame(), good.head(2), good.assign(yhat="none"), good.drop(columns="yhat")][kind]

    aggregates, universe = _chosen(spark, folder)
    rows = forecast.run_batch_forecasts(aggregates, universe, METRIC, model=model)
    error = F.when(F.col("error").startswith("could not convert"), "no number").otherwise(F.col("error"))
    return shown(rows.withColumn("error", error))


@query("history_with_forecast")
def history_with_forecast_query(spark, folder):
    aggregates, universe = _chosen(spark, folder)
    forecasts = forecast.run_batch_forecasts(aggregates, universe, METRIC)
    rows = serve.history_with_forecast(
        forecast.forecast_input(aggregates, universe), forecasts, METRIC
    )
    return shown(rows, value=2)
