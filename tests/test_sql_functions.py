"""The named lists called from SQL."""

import pytest

from claimtrends.operators import serve
from claimtrends.plans import risks_from_features, series_features
from claimtrends.sources import checkpoint_table, register_functions, store

from conftest import series


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def risks(spark, aggregates, tmp_path_factory):
    made = [r for n in range(30) for r in series(
        [float(n % 7 * q * q + n) for q in range(4 + n % 3)], ["CA", "TX", "NY", None][n % 4], str(n))]
    table = checkpoint_table(aggregates(made), "claims")
    df = risks_from_features(series_features(table), table)
    df = store(df, f"{tmp_path_factory.mktemp('risks')}/risks.parquet", ("state",))
    assert register_functions(spark, df) == ["top_spend", "top_risers", "watchlist", "series_history"]
    return df


def same(got, expected):
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


def test_lists_equal_the_functions(spark, risks):
    same(spark.sql("SELECT * FROM top_spend()"), serve.top_spend_latest(risks))
    same(spark.sql("SELECT * FROM top_spend('CA', 3)"), serve.top_spend_latest(risks, "CA", 3))
    same(spark.sql("SELECT * FROM top_risers(k => 4)"), serve.top_risers_latest(risks, None, 4))
    same(spark.sql("SELECT * FROM watchlist(in_state => 'TX')"), serve.watchlist(risks, "TX"))
    same(spark.sql("SELECT * FROM watchlist()"), serve.watchlist(risks))
    same(spark.sql("SELECT * FROM series_history('CA', '4')").drop("product_name_fda10"),
         serve.history_by_series(risks, "CA", "4"))
    assert spark.sql("SELECT * FROM top_spend('none')").isEmpty() and spark.sql("SELECT * FROM watchlist(k => 0)").isEmpty()


def test_a_state_is_cut_out_by_the_scan(spark, risks):
    plan = plan_of(spark.sql("SELECT * FROM watchlist('CA', 5)"))
    assert "PartitionFilters: [isnotnull(state" in plan and "= CA)]" in plan
    assert "TakeOrderedAndProject(limit=5" in plan  # each task keeps k rows before they meet
    assert "PushedFilters: [" in plan_of(spark.sql("SELECT * FROM series_history('CA', '4')"))
    plan = plan_of(spark.sql("SELECT * FROM top_spend('CA', 5)"))
    assert plan.count("= CA)]") >= 2


def test_functions_compose_with_other_sql(spark, risks):
    found = spark.sql("""SELECT s.state, t.total_spend FROM (SELECT DISTINCT state FROM risks WHERE state IS NOT NULL) s,
        LATERAL top_spend(s.state, 1) t""").collect()
    expected = {s: serve.top_spend_latest(risks, s, 1).first().total_spend for s in ("CA", "TX", "NY")}
    assert dict(map(tuple, found)) == expected
