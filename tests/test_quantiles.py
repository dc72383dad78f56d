import numpy as np
import pytest
from pyspark.sql import functions as F

from claimtrends.operators import quantiles


@pytest.fixture(scope="module")
def values(spark):
    """Group "a" has a third of the rows, half of them one value; "b" is spread; "c" tiny."""
    rng = np.random.default_rng(5)
    a = np.where(rng.random(30_000) < 0.5, 50.0, rng.normal(50, 20, 30_000).round(2))
    data = {"a": a, "b": rng.random(60_000) * 1000, "c": np.array([3.0, 1.0]), "d": np.array([4.0])}
    import pandas as pd

    frame = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in data.items()])
    df = spark.createDataFrame(frame).repartition(6).cache()
    return df.unionByName(spark.createDataFrame([("c", None), ("e", None)], "g string, x double")), data


@pytest.mark.parametrize("quantile", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_interpolated_quantile_per_group(values, quantile):
    df, data = values
    got = {r.g: r.q for r in quantiles.exact_quantile(df, "x", quantile, ("g",), "q").collect()}
    assert got.keys() == data.keys()
    for group, x in data.items():
        assert got[group] == pytest.approx(np.quantile(x, quantile), rel=1e-12)


@pytest.mark.parametrize("quantile", [0.25, 0.75, 0.9])
def test_discrete_quantile_of_the_table(values, quantile):
    df, data = values
    everything = np.concatenate(list(data.values()))
    expected = np.quantile(everything, quantile, method="inverted_cdf")
    assert quantiles.exact_quantile(df, "x", quantile, (), "q", interpolate=False).first().q == expected


def test_only_the_bracket_is_ordered(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"))
    bracket = quantiles._brackets(df, "x", [0.75, 0.9], ("g",)).first()
    for i in range(2):
        inside = bracket[f"__high{i}"] - bracket[f"__low{i}"]
        assert 0 < inside < 200_000 * 2 * (quantiles.MARGIN + 2 / quantiles.ACCURACY)


def test_several_quantiles_from_one_pass(values):
    df, data = values
    wanted = {"a": 0.1, "b": 0.75, "c": 0.9}
    got = {r.g: (r.a, r.b, r.c) for r in quantiles.exact_quantiles(df, "x", wanted, ("g",)).collect()}
    for group, x in data.items():
        assert got[group] == pytest.approx(tuple(np.quantile(x, list(wanted.values()))), rel=1e-12)


def test_no_rank_window_over_a_whole_group(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("x"))
    found = quantiles.exact_quantiles(df, "x", {"p": 0.5, "q": 0.9})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("__task" in line for line in plan.splitlines() if "Window [" in line)
    assert tuple(found.first()) == (24_999.5, pytest.approx(44_999.1))


def test_empty_table_gives_null(spark):
    df = spark.createDataFrame([], "x double")
    assert quantiles.exact_quantile(df, "x", 0.5, (), "q").collect() in ([], [(None,)])


def test_sketch_per_group_is_exact_for_small_groups(values):
    df, data = values
    got = quantiles.approx_quantiles(df.where("g in ('c', 'd', 'e')"), "x", {"p": 0.75}, ("g",))
    assert {r.g: r.p for r in got.collect()} == {"c": 3.0, "d": 4.0, "e": None}
