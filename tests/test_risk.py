import itertools
import random

import pytest
from conftest import series

from claimtrends.operators import risk
from claimtrends.operators.features import product_trends, trend_features
from claimtrends.operators.serve import latest_quarter_global

COLUMNS = (
    "total_spend double, spend_75th_percentile double, spend_90th_percentile double,"
    " cv_spend double, qoq_spend_change double, rolling_4q_growth_spend double"
)
POSSIBLE_MEDIUM = {60, 65, 70, 75, 80, 85, 90, 100}


def grade(spark, rows):
    flags = risk.risk_flags(spark.createDataFrame(rows, COLUMNS))
    return risk.risk_score(risk.risk_level(flags))


def test_every_combination_of_inputs(spark):
    spends = [(5.0, 10.0, 20.0), (10.0, 10.0, 20.0), (20.0, 10.0, 20.0), (None, 10.0, 20.0), (1.0, None, None)]
    cvs = [None, 0.5, 1.0, 1.5, 2.5]
    changes = [None, 0.0, 0.35, -0.36, 0.6, -0.8]
    growths = [None, 0.0, 0.25, 0.3, 0.6, -0.3, -0.6]
    rows = [(*s, v, c, g) for s, v, c, g in itertools.product(spends, cvs, changes, growths)]
    for r in grade(spark, rows).collect():
        change = abs(r.qoq_spend_change) if r.qoq_spend_change is not None else None

        def above(x, limit):
            return x is not None and x > limit

        high_cost = None not in (r.total_spend, r.spend_75th_percentile) and r.total_spend >= r.spend_75th_percentile
        high_vol = above(r.cv_spend, 1) or above(change, 0.35)
        extreme_vol = above(r.cv_spend, 2) or above(change, 0.75)
        growth = r.rolling_4q_growth_spend
        assert (r.high_cost, r.high_vol, r.extreme_vol) == (high_cost, high_vol, extreme_vol)
        assert (r.fast_riser, r.extreme_riser) == (above(growth, 0.25), above(growth, 0.5))
        fall = None if growth is None else -growth
        assert (r.declining, r.rapid_decline) == (above(fall, 0.25), above(fall, 0.5))
        if high_cost and (high_vol or r.fast_riser):
            assert (r.risk_level, r.risk_score) == ("high", 100)
        elif any((high_cost, high_vol, r.fast_riser, extreme_vol, r.rapid_decline)):
            points = 50 + 20 * high_cost + 15 * high_vol + 15 * r.fast_riser
            points += 10 * extreme_vol + 10 * r.extreme_riser + 10 * r.rapid_decline
            assert (r.risk_level, r.risk_score) == ("medium", min(points, 100))
            assert r.risk_score in POSSIBLE_MEDIUM
        else:
            assert (r.risk_level, r.risk_score) == ("low", 0)
        assert not r.very_high_cost or r.high_cost


@pytest.fixture(scope="module")
def trended(aggregates):
    rng = random.Random(2)
    rows = [
        r for s in ("CA", "TX") for n in range(25)
        for r in series([round(rng.lognormvariate(3, 1), 2) for _ in range(10)], s, str(n), f"P{n}")
    ]
    return aggregates(rows)


@pytest.mark.parametrize("by_state", [True, False])
def test_rows_are_kept_and_percentiles_ordered(trended, by_state):
    out = risk.flag_risks(trend_features(trended), by_state=by_state)
    assert out.count() == trended.count()
    assert out.where("spend_75th_percentile > spend_90th_percentile").count() == 0
    assert out.where("very_high_cost AND NOT high_cost").count() == 0
    medium = {r.risk_score for r in out.where("risk_level = 'medium'").select("risk_score").collect()}
    assert medium <= POSSIBLE_MEDIUM


def test_stored_and_planned_thresholds_agree(trended):
    features = trend_features(trended)
    stored = risk.spend_thresholds(trended).cache()
    assert sorted(risk.flag_risks(features, thresholds=stored).collect()) == sorted(risk.flag_risks(features).collect())


def test_a_null_state_is_a_group_of_its_own(aggregates):
    rows = aggregates([(None, "1", "A", 0, 5.0), (None, "2", "A", 0, 9.0), ("CA", "1", "A", 0, 1.0)])
    out = risk.spend_percentiles(rows)
    assert sorted((str(r.state), r.spend_75th_percentile) for r in out.collect()) == [
        ("CA", 1.0), ("None", 9.0), ("None", 9.0),
    ]


def test_all_null_spend_raises_no_flag(aggregates):
    rows = aggregates([("CA", "1", "A", q, None) for q in range(3)])
    out = risk.flag_risks(trend_features(rows)).collect()
    assert {(r.risk_level, r.risk_score, r.high_cost) for r in out} == {("low", 0, False)}


def test_dashboard_rules(aggregates):
    rows = aggregates([
        *series([1.0, 1.0, 1.0, 10.0], "CA", "1", "jump"),
        *series([5.0, 5.0, 5.0, 5.0], "CA", "2", "flat"),
        *series([0.0, 0.0, 0.0, 4.0], "CA", "3", "from zero"),
        ("CA", "4", "new", 3, 2.0),
    ])
    latest = latest_quarter_global(product_trends(rows))
    got = {r.product_name_fda10: r for r in risk.dashboard_risks(latest).collect()}
    jump, flat, zero, new = (got[k] for k in ("jump", "flat", "from zero", "new"))
    # Quantile 0.75 of 10, 5, 4, 2 is 6.25.
    assert (jump.high_cost, jump.high_vol, jump.fast_riser, jump.risk_level) == (True, True, True, "high")
    assert jump.risk_score == 100.0
    assert (flat.risk_level, flat.risk_score) == ("low", 0.0)
    assert zero.high_vol and zero.risk_level == "medium" and zero.rolling_4q_growth_spend == 0
    assert new.cv_spend is None and new.risk_score is None and new.risk_level == "low"


def test_dashboard_score_against_numpy_rounding(spark, trended):
    latest = latest_quarter_global(product_trends(trended))
    out = risk.dashboard_risks(latest).toPandas()
    expected = (
        out.high_cost * 30 + out.high_vol * 25 + out.fast_riser * 25 + (out.cv_spend * 20).clip(0, 20)
    ).round(1)
    assert (out.risk_score == expected).all()
    cut = out.groupby("state")["total_spend"].transform(lambda x: x >= x.quantile(0.75))
    assert (out.high_cost == cut).all()
