import datetime as dt

import pandas as pd
import pytest
from conftest import series

from claimtrends.columns import FORECAST_SCHEMA
from claimtrends.operators import forecast
from claimtrends.operators.serve import history_with_forecast, latest_per_series


def run(table, model=None, k=50, metric="spend"):
    universe = forecast.forecast_universe(table, k, metric)
    out = forecast.run_batch_forecasts(table, universe, metric, model)
    assert out.schema.names == FORECAST_SCHEMA.names
    return out.orderBy("state", "ndc11", "forecast_period").collect()


def test_three_points_are_too_few_and_four_enough(aggregates):
    rows = run(aggregates(series([1.0, 2.0, 3.0], ndc="3") + series([1.0, 2.0, 3.0, 4.0], ndc="4")))
    assert [(r.ndc11, r.forecast_period, r.error) for r in rows] == [
        ("3", None, "Insufficient data"), *[("4", h, None) for h in range(1, 5)],
    ]
    assert rows[0].forecast_value is None and rows[0].forecast_date is None


def test_nulls_are_not_points(aggregates):
    rows = run(aggregates(series([1.0, None, 2.0, None, 3.0])))
    assert [r.error for r in rows] == ["Insufficient data"]
    assert [r.error for r in run(aggregates(series([None] * 6)))] == ["Insufficient data"]


def test_dates_are_quarter_ends(aggregates):
    table = aggregates([("CA", "1", "A", q, 5.0) for q in range(16, 20)])
    rows = run(table)
    assert [r.forecast_date for r in rows] == [
        dt.date(2024, 12, 31), dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 9, 30),
    ]
    assert [r.forecast_quarter_start for r in rows] == [
        dt.date(2025, 1, 1), dt.date(2025, 4, 1), dt.date(2025, 7, 1), dt.date(2025, 10, 1),
    ]
    dates = forecast.forecast_dates(table).orderBy("forecast_period").collect()
    assert [r.forecast_date for r in dates] == [r.forecast_date for r in rows]


def test_a_line_is_continued_without_a_band(aggregates):
    rows = run(aggregates(series([10.0 + 2 * q for q in range(12)])))
    for h, r in enumerate(rows, 1):
        assert r.forecast_value == pytest.approx(10 + 2 * (11 + h))
        assert r.forecast_lower == pytest.approx(r.forecast_value, abs=1e-6)


def test_a_seasonal_pattern_is_repeated(aggregates):
    pattern = [50.0, 100.0, 150.0, 100.0]
    rows = run(aggregates(series(pattern * 5)))
    assert [r.forecast_value for r in rows] == pytest.approx(pattern, rel=0.1)
    assert all(r.forecast_lower <= r.forecast_value <= r.forecast_upper for r in rows)


@pytest.mark.parametrize(
    "values", [[0.0] * 6, [1e-12] * 6, [50.0, 30.0, 10.0, 1.0, 0.0, 0.0, 0.0], [-1.0, 1.0, -1.0, 1.0]]
)
def test_degenerate_series_stay_finite(aggregates, values):
    for r in run(aggregates(series(values))):
        assert abs(r.forecast_value) <= 20 * max(1.0, max(map(abs, values)))
        assert r.forecast_lower <= r.forecast_value <= r.forecast_upper


def test_points_in_one_quarter_only(aggregates):
    rows = run(aggregates([("CA", "1", p, 0, 8.0) for p in "ABCD"]))
    assert [r.forecast_value for r in rows] == [8.0] * 4


def test_products_of_a_quarter_form_one_point(aggregates):
    table = aggregates([("CA", "1", p, q, float(q + i)) for q in range(6) for i, p in enumerate("AB")])
    universe = forecast.forecast_universe(table)
    frame = forecast.series_frame(table, universe)
    assert frame.count() == 12
    points = forecast.quarter_points(frame).orderBy("ds").collect()
    assert [(p.y, p.rows) for p in points] == [(q + 0.5, 2) for q in range(6)]


def test_universe_takes_the_latest_value_per_state(aggregates):
    rows = [r for n in range(5) for r in series([100.0 - n, float(n)], ndc=str(n))]
    table = aggregates(rows + series([1.0], "TX", "9"))
    top = forecast.forecast_universe(table, 2)
    assert {(r.state, r.ndc11_normalized) for r in top.collect()} == {("CA", "4"), ("CA", "3"), ("TX", "9")}
    assert forecast.forecast_input(table, top).count() == 5


def test_units_metric(aggregates):
    rows = run(aggregates(series([8.0] * 5)), metric="units")
    assert {(r.metric, r.forecast_value) for r in rows} == {("units", 4.0)}


def test_a_failing_series_does_not_touch_the_others(aggregates):
    def model(points: pd.DataFrame, horizon: int) -> pd.DataFrame:
        if points["y"].max() > 50:
            raise ValueError("too large")
        y = [float(points["y"].iloc[-1])] * horizon
        return pd.DataFrame({"yhat": y, "yhat_lower": y, "yhat_upper": y})

    table = aggregates(
        series([1.0] * 5, ndc="1") + series([99.0] * 5, ndc="2") + series([1.0], ndc="3") + series([None], ndc="4")
    )
    rows = run(table, model)
    assert [(r.ndc11, r.forecast_period, r.forecast_value, r.error) for r in rows] == [
        *[("1", h, 1.0, None) for h in range(1, 5)],
        ("2", None, None, "too large"),
        ("3", None, None, "Insufficient data"),
        ("4", None, None, "Insufficient data"),
    ]
    assert rows[0].forecast_date == dt.date(2021, 3, 31)


def test_history_and_forecast_share_a_table(aggregates):
    table = aggregates(series([3.0] * 4) + series([1.0], ndc="2"))
    universe = forecast.forecast_universe(table)
    both = history_with_forecast(table, forecast.run_batch_forecasts(table, universe), "spend")
    kinds = [r.type for r in both.orderBy("ndc11_normalized", "quarter_start").collect()]
    assert kinds == ["historical"] * 4 + ["forecast"] * 4 + ["historical"]


@pytest.mark.parametrize("kind,message", [
    ("empty", "the model gave no yhat"), ("short", "the model gave 3 steps of 4"),
    ("text", "could not convert"), ("missing", "the model gave no yhat_upper"), ("none", ""),
    ("silent", "KeyError"),
])
def test_a_model_cannot_stop_the_others(spark, aggregates, kind, message):
    """Each fault is the error row of its series; the other series is forecast."""

    def model(points, horizon):
        good = pd.DataFrame({c: [points["y"].iloc[-1]] * horizon for c in ("yhat", "yhat_lower", "yhat_upper")})
        assert str(points["ds"].dtype).startswith("datetime64")
        if points["y"].iloc[0] < 100:
            return good
        if kind == "silent":
            raise KeyError
        return {"empty": pd.DataFrame(), "short": good.head(3), "text": good.assign(yhat="x"),
                "missing": good[["yhat", "yhat_lower"]], "none": None}[kind]

    history = aggregates(series([1.0] * 5) + series([200.0] * 5, ndc="2"))
    universe = forecast.forecast_universe(history, 5)
    rows = forecast.run_batch_forecasts(history, universe, "spend", model=model).collect()
    assert sorted(r.forecast_value for r in rows if r.ndc11 == "1") == [1.0] * 4
    bad = [r for r in rows if r.ndc11 == "2"]
    assert len(bad) == 1 and message in bad[0].error and bad[0].error and bad[0].forecast_value is None


def test_only_series_long_enough_are_fitted(aggregates):
    rows = [*series([1.0, 2.0, 3.0, 4.0, 5.0], ndc="long"), *series([1.0, 2.0, 3.0], ndc="short"),
            *[("CA", "names", p, 0, 2.0) for p in "ABCD"], ("CA", None, "A", 0, 1.0)]
    table = aggregates(rows)
    everything = latest_per_series(table)
    frame = forecast.series_frame(table, everything)
    fits = forecast._fits(forecast.quarter_points(frame)).collect()
    assert {(r.ndc11_normalized, r.points, r.quarters, r.seasons) for r in fits} == {("long", 5, 5, 1), ("names", 4, 1, 0)}
    found = forecast.forecast_seasonal_trend(frame, everything).collect()
    assert sorted((str(r.ndc11), r.error, r.forecast_date is None) for r in found) == sorted(
        [(n, None, False) for n in ("long", "names") for _ in range(4)]
        + [(n, forecast.TOO_SHORT, True) for n in ("None", "short")])
