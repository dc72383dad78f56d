import math
import random

import pandas as pd
import pytest
from conftest import column, series

from claimtrends.columns import PRODUCT_SERIES
from claimtrends.operators import features


def close(actual, expected):
    assert len(actual) == len(expected)
    for a, e in zip(actual, expected):
        if e is None:
            assert a is None
        else:
            assert a == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_constant_series(aggregates):
    out = features.trend_features(aggregates(series([7.0] * 9)))
    close(column(out, "qoq_spend_change"), [None] + [0.0] * 8)
    close(column(out, "t4q_spend_std"), [None] + [0.0] * 8)
    close(column(out, "cv_spend"), [None] + [0.0] * 8)
    close(column(out, "rolling_4q_growth_spend"), [None] * 4 + [3.0, 1.0, 1 / 3, 0.0, 0.0])
    assert set(column(out, "trend_direction_spend")) == {"stable"}


def test_growth_can_ask_for_four_prior_rows(aggregates):
    out = features.rolling_growth(aggregates(series([7.0] * 9)), min_prior=4)
    close(column(out, "rolling_4q_growth_spend"), [None] * 7 + [0.0, 0.0])


def test_one_row_series(aggregates):
    row = features.trend_features(aggregates(series([7.0])), lags=(1, 2, 4)).first()
    assert row.qoq_spend_change is None and row.t4q_spend_std is None
    assert row.cv_spend is None and row.spend_lag_1q is None and row.t4q_spend_avg == 7.0


def test_change_from_zero(aggregates):
    rows = aggregates(series([0.0, 5.0, 0.0, 0.0]))
    close(column(features.qoq_change(rows), "qoq_spend_change"), [None, None, -1.0, None])
    demo = column(features.qoq_change_by_product(rows), "qoq_spend_change")
    assert demo == [None, math.inf, -1.0, None]


def test_trend_direction_limits(aggregates):
    rows = aggregates(series([100.0, 106.0, 106.0, 90.0]))
    assert column(features.trend_direction(rows), "trend_direction_spend") == [
        "stable", "increasing", "stable", "decreasing",
    ]


def test_a_missing_quarter_is_bridged(aggregates):
    rows = aggregates([("CA", "1", "A", 0, 10.0), ("CA", "1", "A", 5, 20.0)])
    close(column(features.qoq_change(rows), "qoq_spend_change"), [None, 1.0])


def test_two_products_in_a_quarter_have_a_stable_order(spark, aggregates):
    rows = [("CA", "1", p, q, float(10 * q + i)) for q in range(4) for i, p in enumerate("AB")]
    random.Random(1).shuffle(rows)
    order = ("quarter_start", "product_name_fda10")
    lags = column(features.lag_features(aggregates(rows)), "spend_lag_1q", *order)
    assert lags == [None, 0.0, 1.0, 10.0, 11.0, 20.0, 21.0, 30.0]


def test_single_operators_agree_with_the_combined_one(aggregates):
    rng = random.Random(3)
    rows = aggregates([r for s in ("CA", "TX") for r in series([rng.uniform(0, 9) for _ in range(12)], s)])
    whole = features.trend_features(rows, lags=features.DEFAULT_LAGS)
    for operator in (
        features.qoq_change, features.rolling_stats, features.variation,
        features.rolling_growth, features.trend_direction, features.lag_features,
    ):
        part = operator(rows)
        assert not [c for c in part.columns if c.startswith("__")]
        same = whole.select(*part.columns)
        assert sorted(part.collect()) == sorted(same.collect())


def test_against_pandas(spark, aggregates):
    rng = random.Random(7)
    rows = [
        r for s in ("CA", "TX", "NY") for n in "123"
        for r in series([round(rng.uniform(1, 100), 2) for _ in range(rng.randint(1, 15))], s, n, n)
    ]
    got = features.product_trends(aggregates(rows)).toPandas()
    got = got.sort_values(["state", "product_name_fda10", "quarter_start"], ignore_index=True)
    groups = got.groupby(["state", "product_name_fda10"])["total_spend"]
    rolling = groups.rolling(4, min_periods=1)
    expected = pd.DataFrame({
        "qoq_spend_change": groups.pct_change(),
        "rolling_4q_spend_avg": rolling.mean().reset_index(drop=True),
        "rolling_4q_spend_std": rolling.std().reset_index(drop=True),
        "rolling_4q_growth_spend": groups.transform(lambda v: (v - v.shift(3)) / v.shift(3)).fillna(0),
    })
    expected["cv_spend"] = expected["rolling_4q_spend_std"] / expected["rolling_4q_spend_avg"]
    for name in expected:
        pd.testing.assert_series_equal(got[name], expected[name], check_names=False, rtol=1e-9)


def test_product_series_ignore_the_code(aggregates):
    rows = aggregates([("CA", str(q), "A", q, float(q + 1)) for q in range(3)])
    close(column(features.qoq_change_by_product(rows, PRODUCT_SERIES), "qoq_spend_change"), [None, 1.0, 0.5])


def test_calendar_frames_count_quarters(aggregates):
    """A missing quarter is not bridged, and all products of a quarter are in its frames."""
    rows = [("CA", "1", p, q, v) for q, p, v in [
        (0, "A", 10.0), (1, "A", 4.0), (1, "B", 8.0), (3, "A", 6.0), (4, "A", 9.0), (9, "A", 2.0), (9, "B", None)]]
    out = features.calendar_features(aggregates(rows))
    order = ("quarter_start", "product_name_fda10")
    close(column(out, "calendar_spend_change", *order), [None, 0.2, 0.2, None, 0.5, None, None])
    close(column(out, "calendar_4q_spend_avg", *order), [10.0, 22 / 3, 22 / 3, 7.0, 27 / 4, 2.0, 2.0])
    close(column(out, "calendar_spend_lag_1q", *order), [None, 10.0, 10.0, None, 6.0, None, None])
    close(column(out, "calendar_spend_lag_2q", *order), [None, None, None, 12.0, None, None, None])
    close(column(out, "calendar_4q_growth_spend", *order), [None, None, None, None, 1.7, -13 / 15, -13 / 15])
    assert not [c for c in out.columns if c.startswith("__")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert features.calendar_features(aggregates([])).count() == 0
