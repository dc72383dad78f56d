"""What the physical plans must and must not hold."""

import pytest

from claimtrends.operators import features, forecast, risk, serve
from claimtrends.plans import aggregates_from_claims, stages_from_claims
from claimtrends.sources import checkpoint_table
from suite import claims as source
from suite.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    return aggregates_from_claims(source.claims(spark, FOLDER), 2)


@pytest.mark.parametrize("name", [
    "pipeline_risks", "top_spend_latest", "demo_risk", "forecast_batch", "flag_risks", "canonicalize",
    "universe_summary",
])
def test_native_paths_stay_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for operator in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_only_the_model_hook_uses_python(spark):
    assert "FlatMapGroupsInPandas" in plan_of(QUERIES["forecast_grouped_map"](spark, FOLDER))


def test_all_features_share_one_exchange_sort_and_window(stored):
    plan = plan_of(features.trend_features(stored, lags=features.DEFAULT_LAGS))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort ") == 1 and plan.count("Window [") == 1


def test_stored_thresholds_are_broadcast_by_size(spark, stored):
    trends = features.trend_features(stored)
    small = checkpoint_table(risk.spend_thresholds(stored), "thresholds")
    assert plan_of(risk.flag_risks(trends, thresholds=small)).count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan_of(risk.flag_risks(trends, thresholds=small))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        assert "SortMergeJoin" in plan_of(risk.flag_risks(trends, thresholds=small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranks_are_cut_before_the_shuffle(stored):
    assert plan_of(serve.latest_per_series(stored)).count("WindowGroupLimit") == 2
    assert plan_of(forecast.forecast_universe(stored, 5)).count("WindowGroupLimit") >= 3


def test_top_lists_do_not_sort_the_table(stored):
    assert "TakeOrderedAndProject" in plan_of(serve.top_spend_latest_global(stored))
    assert "+- Sort " not in plan_of(serve.top_spend_latest_global(stored))


def test_filters_and_columns_reach_the_scan(stored):
    rows = serve.filter_states(features.qoq_change(stored), ["05"]).select("state", "qoq_spend_change")
    plan = plan_of(rows)
    assert "PushedFilters: [EqualTo(state,05)]" in plan or "PushedFilters: [In(state, [05])" in plan or "state,05" in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "medicaid_spend" not in schema and "total_units" not in schema


def test_claims_are_filtered_before_their_joins(spark):
    plan = plan_of(QUERIES["quarterly_aggregates"](spark, FOLDER))
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_type:string>" in plan


def test_distinct_counts_run_on_reduced_rows(stored):
    plan = plan_of(serve.kpi_summary(stored))
    expand = plan.index("Expand")
    assert "partial_sum" in plan[expand:] and "FileScan" in plan[expand:]


def test_stage_reads_stop_at_the_stored_aggregates(spark):
    plan = plan_of(stages_from_claims(source.claims(spark, FOLDER), 2).risks)
    assert "lineitem" not in plan and "aggregates-" in plan
