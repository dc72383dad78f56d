import random

import pytest
from pyspark.sql import functions as F

from claimtrends.columns import DRUG_SERIES, PRODUCT_SERIES
from claimtrends.operators import features, long_series
from claimtrends.plans import product_features, series_features


@pytest.fixture(scope="module")
def skewed(aggregates):
    """One code holds a third of all rows: many products in each of a few quarters."""
    rng = random.Random(11)
    hot = [("CA", "0", f"P{p:03d}", q, round(rng.uniform(0, 100), 2)) for q in range(6) for p in range(70)]
    cold = [
        (s, str(n), "A", q, round(rng.uniform(0, 100), 2))
        for s in ("CA", "TX", "NY") for n in range(1, 15) for q in range(20)
    ]
    rows = hot + cold
    rng.shuffle(rows)
    return aggregates(rows).repartition(5).cache()


def rows_of(df):
    names = sorted(df.columns)
    return sorted(df.select(*names).collect(), key=str)


@pytest.mark.parametrize("max_rows", [1, 7, 20, 64, 419])
def test_blocks_give_the_values_of_the_whole_series(skewed, max_rows):
    whole = features.trend_features(skewed, lags=features.DEFAULT_LAGS)
    blocks = series_features(skewed, max_rows=max_rows)
    assert sorted(blocks.columns) == sorted(whole.columns)
    assert rows_of(blocks) == rows_of(whole)


def test_long_lags_widen_the_overlap(skewed):
    whole = features.trend_features(skewed, lags=(12,))
    assert rows_of(series_features(skewed, lags=(12,), max_rows=15)) == rows_of(whole)


def test_product_series_too(aggregates):
    rows = aggregates([("CA", f"{n:03d}", "A", q, float(n * q + 1)) for q in range(5) for n in range(40)])
    assert rows_of(product_features(rows, PRODUCT_SERIES, 30)) == rows_of(features.product_trends(rows))


def test_no_task_gets_a_whole_long_series(skewed):
    blocks = long_series._blocks(skewed.where("ndc11_normalized = '0'"), DRUG_SERIES, 50, 7)
    sizes = [r["count"] for r in blocks.groupBy("__block").count().collect()]
    assert max(sizes) <= 57 and len(sizes) == 9
    assert blocks.where(~F.col("__halo")).count() == 420


def test_usual_series_take_the_plain_path(skewed):
    plan = series_features(skewed)._jdf.queryExecution().executedPlan().toString()
    assert "__block" not in plan
