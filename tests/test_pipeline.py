import pytest
from pyspark.sql import functions as F

from claimtrends.columns import RiskRules
from claimtrends.operators import serve
from claimtrends.plans import dashboard, forecast, product_features, run, stages_from_claims
from claimtrends.sources import export_csv, load_forecasts, read_parquet
from suite import claims as source

FOLDER = "/root/testdata/sf0.001"


def test_csv_to_stage_tables_views_and_forecasts(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    export_csv(source.raw_claims(spark, FOLDER), raw)
    stages = run(spark, raw, out, decimals=2)
    direct = stages_from_claims(source.claims(spark, FOLDER), 2)
    for name in ("aggregates", "features", "risks"):
        stored, planned = read_parquet(spark, f"{out}/{name}.parquet"), getattr(direct, name)
        assert sorted(stored.select(*planned.columns).collect()) == sorted(planned.collect())
        assert getattr(stages, name).count() == spark.table(name).count()
    assert "spend_lag_4q" in stages.risks.columns
    totals = spark.sql("SELECT sum(total_spend) AS s, count(*) AS n FROM combined_data").first()
    assert totals.n == stages.aggregates.count()
    assert totals.s == pytest.approx(source.claims(spark, FOLDER).agg(F.sum("total_amount")).first()[0])

    forecasts = forecast(spark, out, "units", top_k=3)
    assert forecasts.select("state", "ndc11").distinct().count() == 3 * spark.table("risks").select("state").distinct().count()
    assert load_forecasts(spark, f"{out}/forecasts_units.parquet").count() == forecasts.count()
    assert load_forecasts(spark, f"{out}/forecasts_spend.parquet").count() == 0


def test_pipeline_with_table_wide_thresholds_and_no_lags(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    export_csv(source.raw_claims(spark, FOLDER), raw)
    stages = run(spark, raw, out, lags=(), by_state=False, uniform_headers=True)
    assert stages.risks.select("spend_75th_percentile").distinct().count() == 1
    assert "spend_lag_1q" not in stages.risks.columns


def test_dirty_rows_are_left_out_once(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    export_csv(source.messy_claims(spark, FOLDER), raw)
    loose = run(spark, raw, out + "1").aggregates.agg(F.sum("total_scripts")).first()[0]
    strict = run(spark, raw, out + "2", strict=True)
    assert loose > 0 and strict.aggregates.count() == 0  # states there are a letter and a digit
    assert strict.counts["raw"] > 0 and strict.counts["cleansed"] == strict.counts["risks"] == 0


def test_options_of_a_run(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    export_csv(source.raw_claims(spark, FOLDER), raw)
    rules = RiskRules(growth_fast=1e9)
    stages = run(spark, raw, out, decimals=2, rules=rules, min_prior=4, partition_by=("state",), universe_k=2)
    tables = {"aggregates": stages.aggregates, "features": stages.features, "risks": stages.risks}
    assert stages.counts == {
        "raw": spark.read.parquet(f"{FOLDER}/lineitem.parquet").count(), "cleansed": stages.counts["raw"],
        **{name: table.count() for name, table in tables.items()},
    }
    assert stages.universe.groupBy("state").count().agg(F.max("count")).first()[0] == 2
    assert stages.risks.where("fast_riser").count() == 0
    usual = run(spark, raw, out + "2", decimals=2).features
    growth = "rolling_4q_growth_spend is not null"
    assert 0 < stages.features.where(growth).count() < usual.where(growth).count()
    assert dict(stages.risks.dtypes)["state"] == "string"
    one = serve.history_by_series(stages.risks, "05", "00000000013")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(state" in one


def test_dashboard_chooses_states_before_the_latest_quarter(aggregates):
    table = aggregates(
        [("CA", "1", "A", q, 1.0) for q in range(3)] + [("TX", "2", "B", q, 2.0) for q in range(2)]
    )
    trends = product_features(table)
    assert {r.state for r in dashboard(trends).latest.collect()} == {"CA"}
    chosen = dashboard(trends, ["TX"])
    assert [(r.state, r.total_spend) for r in chosen.top_spend.collect()] == [("TX", 2.0)]
    assert chosen.summary.first().total_spend == 4.0


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for partitions in (1, 4, 8):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append(sorted(stages_from_claims(source.claims(spark, FOLDER), 2).risks.collect()))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
