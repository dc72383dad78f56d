import datetime as dt

import pytest
from conftest import quarter
from pyspark.sql import functions as F

from claimtrends.operators.aggregate import quarterly_aggregates, quarterly_totals, safe_ratios_zero

SCHEMA = (
    "state string, ndc11_normalized string, product_name_fda10 string, quarter_start date,"
    " units_reimbursed double, prescriptions bigint, total_amount double,"
    " medicaid_amount double, non_medicaid_amount double"
)
Q1 = dt.date(2024, 1, 1)


def test_nulls_count_as_zero_and_null_product_is_a_group(spark):
    rows = spark.createDataFrame([
        ("CA", "1", None, Q1, None, None, 10.0, None, None),
        ("CA", "1", None, Q1, 2.0, None, None, 4.0, 6.0),
        ("CA", "1", "A", Q1, 1.0, 1, 5.0, 5.0, 0.0),
    ], SCHEMA)
    out = {r.product_name_fda10: r for r in quarterly_aggregates(rows).collect()}
    none = out[None]
    assert (none.total_units, none.total_scripts, none.total_spend) == (2.0, 0, 10.0)
    assert none.spend_per_script is None and none.spend_per_unit == 5.0
    assert none.medicaid_share == 0.4 and out["A"].spend_per_script == 5.0


def test_decimals_make_sums_independent_of_order(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.07, 0.4] * 200
    rows = [("CA", "1", "A", Q1, v, 1, v, v, v) for v in values]
    first = quarterly_aggregates(spark.createDataFrame(rows, SCHEMA).repartition(7), 2).first()
    second = quarterly_aggregates(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), 2).first()
    assert first.total_spend == second.total_spend == 200 * 100000000107 / 100


def test_plain_sums_keep_all_decimals(spark):
    rows = spark.createDataFrame([("CA", "1", "A", Q1, 0.0, 1, 0.0001, 0.0, 0.0)] * 2, SCHEMA)
    assert quarterly_aggregates(rows).first().total_spend == 0.0002


def test_by_state_only_moves_rows(spark):
    rows = spark.createDataFrame([("CA", "1", "A", Q1, 1.0, 1, 2.0, 1.0, 1.0)], SCHEMA)
    assert quarterly_aggregates(rows, by_state=True).collect() == quarterly_aggregates(rows).collect()


def test_display_ratios_are_zero_without_denominator(spark):
    totals = spark.createDataFrame(
        [(10.0, 3, 0.0)], "total_spend double, total_scripts bigint, total_units double"
    )
    row = safe_ratios_zero(totals).first()
    assert (row.spend_per_script, row.spend_per_unit) == (3.33, 0.0)


def test_a_hot_key_reaches_the_shuffle_as_one_row_per_task(spark):
    rows = spark.range(30_000, numPartitions=6).select(
        F.lit("CA").alias("state"), F.lit("1").alias("ndc11_normalized"),
        F.lit("A").alias("product_name_fda10"), F.lit(Q1).alias("quarter_start"),
        F.lit(1.0).alias("units_reimbursed"), F.lit(1).cast("bigint").alias("prescriptions"),
        *[F.lit(1.0).alias(c) for c in ("total_amount", "medicaid_amount", "non_medicaid_amount")],
    )
    out = quarterly_aggregates(rows)
    assert "partial_sum" in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().total_scripts == 30_000


def test_decimals_keep_units_and_refuse_to_lose_any(spark):
    rows = [("CA", "1", "A", quarter(0), 0.004, 1, 10.25, 5.05, 5.2)] * 5
    names = "state string, ndc11_normalized string, product_name_fda10 string, quarter_start date," \
        " units_reimbursed double, prescriptions bigint, total_amount double, medicaid_amount double," \
        " non_medicaid_amount double"
    claims = spark.createDataFrame(rows, names)
    got = quarterly_totals(claims, decimals=2).first()
    assert got.total_units == pytest.approx(0.02) and got.total_spend == 51.25
    assert quarterly_totals(claims, decimals={"units_reimbursed": 3}).first().total_units == 0.02
    with pytest.raises(Exception, match="units_reimbursed has more than 2 decimals"):
        quarterly_totals(claims, decimals={"units_reimbursed": 2}).collect()
    with pytest.raises(Exception, match="total_amount has more than 1 decimals"):
        quarterly_totals(claims, decimals=1).collect()
    noisy = claims.withColumn("total_amount", F.lit(123.45) + F.lit(0.005))
    assert quarterly_totals(noisy, decimals=3).first().total_spend == 617.275
