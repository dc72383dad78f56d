import math

import numpy as np
import pytest

from claimtrends.operators import changepoints, forecast, serve
from claimtrends.operators.changepoints import TrendModel

from conftest import column, series

MODEL = TrendModel()


def design(t, quarter):
    q = quarter - 1
    return [1, t, *[max(0, t - MODEL.every * (k + 1)) for k in range(MODEL.changes)],
            [1, 0, -1, 0][q], [0, 1, 0, -1][q], [1, -1, 1, -1][q]]


def plain_fit(points):
    """numpy's ridge solution of (t, quarter of the year, y) points."""
    x = np.array([design(t, q) for t, q, _ in points], float)
    y = np.array([p[2] for p in points])
    return np.linalg.solve(x.T @ x + np.diag(MODEL.penalties()), x.T @ y)


def plain_backtest(values):
    """values by quarter number from the first quarter of 2020, None for a gap."""
    points = [(t, t % 4 + 1, v) for t, v in enumerate(values) if v is not None]
    first = points[0][0]
    points = [(t - first, q, v) for t, q, v in points]
    known, out = {t: v for t, _, v in points}, []
    for n in range(MODEL.least_origin, len(points) + 1):
        b = plain_fit(points[:n])
        t, q, _ = points[n - 1]
        out += [(t + first, h, float(b @ design(t + h, (q - 1 + h) % 4 + 1)), known[t + h]) for h in range(1, 5) if t + h in known]
    return out


def wave(rng, n, noise=5.0, bend=12):
    t = np.arange(n)
    return (100 + 3 * t - 5 * np.maximum(0, t - bend) + 10 * np.cos(t * np.pi / 2) + noise * rng.normal(size=n)).tolist()


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(2)
    gaps = wave(rng, 30)
    for i in (0, 1, 9, 10, 11, 20):
        gaps[i] = None
    return {"full": wave(rng, 32), "gaps": gaps, "short": wave(rng, 9), "flat": [7.0] * 20, "tiny": [1.0, 2.0, 3.0]}


def test_backtest_equals_numpy_fits(spark, aggregates, cases):
    rows = [r for name, values in cases.items() for r in series(values, ndc=name) if r[4] is not None]
    frame = forecast.series_frame(aggregates(rows), aggregates(rows))
    got = {}
    for r in changepoints.backtest(frame).collect():
        origin = (r.origin.year - 2020) * 4 + (r.origin.month - 1) // 3
        assert r.error == pytest.approx(r.actual - r.forecast)
        got.setdefault(r.ndc11_normalized, []).append((origin, r.step, r.forecast, r.actual))
    for name, values in cases.items():
        want = plain_backtest(values)
        mine = sorted(got.get(name, []))
        assert [x[:2] for x in mine] == [x[:2] for x in sorted(want)]
        assert [v for x in mine for v in x[2:]] == pytest.approx([v for x in sorted(want) for v in x[2:]], rel=1e-8)


def test_forecast_and_band(spark, aggregates, cases):
    rows = [r for name, values in cases.items() for r in series(values, ndc=name) if r[4] is not None]
    history = aggregates(rows)
    universe = serve.latest_per_series(history)
    out = changepoints.forecast_changepoint(forecast.series_frame(history, universe), universe)
    assert out.columns == [f.name for f in forecast.FORECAST_SCHEMA]
    found = {}
    for r in out.collect():
        found.setdefault(r.ndc11, {})[r.forecast_period] = r
    for name, values in cases.items():
        if name == "tiny":
            assert found[name].keys() == {None} and found[name][None].error == forecast.TOO_SHORT
            continue
        points = [(t, t % 4 + 1, v) for t, v in enumerate(values) if v is not None]
        first, (last, q, _) = points[0][0], points[-1]
        b = plain_fit([(t - first, s, v) for t, s, v in points])
        for h in range(1, 5):
            r = found[name][h]
            value = float(b @ design(last - first + h, (q - 1 + h) % 4 + 1))
            assert r.forecast_value == pytest.approx(value, rel=1e-8)
            errors = sorted([abs(a - f) for _, s, f, a in plain_backtest(values) if s == h][-MODEL.recent:])
            place = math.ceil((len(errors) + 1) * 0.8)
            if place > len(errors):
                assert r.forecast_lower is None and r.forecast_upper is None
            else:
                assert r.forecast_upper - r.forecast_value == pytest.approx(errors[place - 1], rel=1e-6, abs=1e-9)
                assert r.forecast_value - r.forecast_lower == pytest.approx(errors[place - 1], rel=1e-6, abs=1e-9)


def test_coverage_on_held_out_quarters(spark, aggregates):
    """Bands from 32 quarters hold about four fifths of the next four, which the model has not seen."""
    rng = np.random.default_rng(7)
    values = {f"{i:03d}": wave(rng, 36, noise=1 + i % 9, bend=10 + i % 7) for i in range(150)}
    history = aggregates([r for name, v in values.items() for r in series(v[:32], ndc=name)])
    universe = serve.latest_per_series(history)
    out = changepoints.forecast_changepoint(forecast.series_frame(history, universe), universe).collect()
    inside = [r.forecast_lower <= values[r.ndc11][31 + r.forecast_period] <= r.forecast_upper for r in out]
    assert len(inside) == 600 and 0.72 <= np.mean(inside) <= 0.9
    plain = forecast.forecast_seasonal_trend(forecast.series_frame(history, universe), universe).collect()
    error = {name: np.mean([abs(r.forecast_value - values[r.ndc11][31 + r.forecast_period]) for r in rows])
             for name, rows in (("bend", out), ("line", plain))}
    assert error["bend"] < 0.7 * error["line"]  # the trend of these series bends


def test_one_quarter_and_no_rows(spark, aggregates):
    rows = [("CA", "1", p, 3, 5.0) for p in "ABCD"]
    history = aggregates(rows)
    universe = serve.latest_per_series(history)
    frame = forecast.series_frame(history, universe)
    out = changepoints.forecast_changepoint(frame, universe)
    assert all(math.isfinite(v) for v in column(out, "forecast_value", "forecast_period"))
    assert changepoints.backtest(frame).count() == 0
    assert changepoints.forecast_changepoint(frame.limit(0), universe).collect()[0].error == forecast.TOO_SHORT
    assert changepoints.forecast_changepoint(frame, universe.limit(0)).count() == 0


def test_one_exchange_for_all_origins(spark, aggregates):
    history = aggregates(series(wave(np.random.default_rng(1), 20)))
    frame = forecast.series_frame(history, serve.latest_per_series(history))
    plan = changepoints.backtest(frame)._jdf.queryExecution().executedPlan().toString()
    frame_plan = forecast.quarter_points(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - frame_plan.count("Exchange hashpartitioning") <= 1
    assert "Python" not in plan and "Cartesian" not in plan
