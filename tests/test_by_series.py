"""Tables laid out by series: plans without exchange, one bucket a lookup, null keys, long series."""

import pytest

from claimtrends.operators import features, risk, serve
from claimtrends.operators.joins import combined_join
from claimtrends.plans import by_series, series_features
from claimtrends.sources import checkpoint_table

from conftest import series


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, (tuple(sorted(r.asDict().items())) for r in df.collect())))


@pytest.fixture(scope="module")
def claims(aggregates):
    """Short series, null states, codes and names, and one series with a third of all rows."""
    made = [r for n in range(40) for r in series([float(n + q) for q in range(6)], "CA" if n % 2 else "TX", str(n))]
    made += series([5.0, 7.0, 6.0], None, "7") + series([1.0, 2.0], "CA", None) + series([3.0, None], None, None)
    made += [("TX", "hot", None if p == 3 else f"P{p}", q, float(p * q)) for p in range(20) for q in range(6)]
    return checkpoint_table(aggregates(made), "claims")


def stored(claims, **how):
    first = by_series.store_by_series(claims, "t_aggregates", **how)
    made = by_series.store_in_place(*by_series.features_by_series(first), first, "t_features")
    thresholds = checkpoint_table(risk.spend_thresholds(first.rows()), "thresholds")
    graded = [None if t is None else risk.flag_risks(t, thresholds=thresholds) for t in (made.usual, made.long)]
    return first, made, by_series.store_in_place(*graded, first, "t_risks")


@pytest.fixture
def in_place(spark):
    before = spark.conf.get(by_series.ALL_KEYS)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    by_series.keep_in_place(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set(by_series.ALL_KEYS, before)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)


def test_features_and_joins_of_stored_tables_have_no_exchange(claims, in_place):
    stages = stored(claims)
    assert "Exchange" not in plan_of(by_series.features_by_series(stages[0])[0])
    joined = plan_of(by_series.combined_by_series(*stages))
    assert "Exchange" not in joined and joined.count("SortMergeJoin") == 2 and "Bucketed: true" in joined
    assert "Exchange" in plan_of(features.trend_features(claims))


@pytest.mark.parametrize("how", [{}, {"max_rows": 50}, {"max_rows": 4}, {"buckets": 16}])
def test_every_layout_gives_the_same_rows(claims, in_place, how):
    first, made, risks = stored(claims, **how)
    assert (first.long is None) == ("max_rows" not in how)
    assert rows(first.rows()) == rows(claims)
    trends = checkpoint_table(series_features(claims), "trends")
    assert rows(made.rows()) == rows(trends)
    graded = checkpoint_table(risk.flag_risks(trends), "graded")
    assert rows(risks.rows()) == rows(graded)
    assert rows(by_series.combined_by_series(first, made, risks)) == rows(combined_join(claims, trends, graded))
    for state, code in (("CA", "3"), ("TX", "hot"), ("none", "3")):
        assert rows(by_series.history_in_place(risks, state, code)) == rows(serve.history_by_series(graded, state, code))


def test_a_long_series_is_in_no_bucket(claims):
    table = by_series.store_by_series(claims, "t_hot", max_rows=50)
    assert table.long.select("ndc11_normalized").distinct().collect() == [("hot",)]
    assert table.usual.where("ndc11_normalized = 'hot'").isEmpty()


def rows_read(spark, table, code):
    """Rows that the scans of a lookup gave out, from their metrics."""
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages hide the scans
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a sort over more reads a sample first
    try:
        df = by_series.history_in_place(table, "CA", code)
        df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_reads_one_bucket(spark, claims):
    table = stored(claims, buckets=16)[2]
    found = by_series.history_in_place(table, "CA", "3")
    assert "PushedFilters: [" in plan_of(found) and "EqualTo(series_id," in plan_of(found)
    in_bucket = table.usual.where("pmod(hash(series_id), 16) = pmod(hash(xxhash64('CA', '3')), 16)").count()
    assert found.count() == 6 and rows_read(spark, table, "3") <= in_bucket < claims.count() / 3
    assert rows_read(spark, table, "no such code") == 0  # not in the statistics or the bloom filter of its row group


def test_null_keys_empty_tables_and_a_clashing_name(claims, aggregates, in_place):
    nobody = checkpoint_table(claims.where("false"), "nobody")
    stages = stored(nobody)
    assert by_series.combined_by_series(*stages).isEmpty() and by_series.history_in_place(stages[2], "CA", "1").isEmpty()
    with pytest.raises(ValueError, match="series_id"):
        by_series.store_by_series(claims.selectExpr("*", "1 as series_id"), "t_clash")
    with pytest.raises(ValueError, match="alike"):
        by_series.combined_by_series(by_series.store_by_series(claims, "a", buckets=4),
                                     by_series.store_by_series(claims, "b", buckets=8))


def test_buckets_grow_with_the_table_by_powers_of_two():
    counts = [by_series.bucket_count(n) for n in (0, 10**6, 10**8, 10**10)]
    assert counts == [4, 4, 64, 8192]
