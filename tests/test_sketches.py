"""Merged sketches against exact ranks."""

import random

import pytest

from claimtrends.operators import sketches
from claimtrends.operators.risk import spend_thresholds
from claimtrends.sources import checkpoint_table

SCHEMA = "state string, quarter_start date, total_spend double"


@pytest.fixture(scope="module")
def spends(spark):
    return spark.range(400_000).selectExpr(
        "case when id % 3 = 0 then 'hot' else cast(id % 11 as string) end as state",
        "make_date(2020 + cast(id % 8 div 4 as int), cast(id % 4 * 3 + 1 as int), 1) as quarter_start",
        "case when id % 17 = 0 then null else cast(pmod(xxhash64(id), 1000003) as double) end as total_spend",
    )


def known(df, state):
    return sorted(r.total_spend for r in df.where(f"state = '{state}' and total_spend is not null").collect())


def test_merged_thresholds_are_within_the_stated_rank_error(spends):
    stored = checkpoint_table(sketches.spend_sketches(spends), "sketches")
    found = {r.state: r for r in sketches.thresholds_of(sketches.merge_sketches(stored, ("state",)), ("state",)).collect()}
    assert len(found) == 12
    for state in ("hot", "1"):
        values = known(spends, state)
        for name, share in (("spend_75th_percentile", 0.75), ("spend_90th_percentile", 0.90)):
            rank = sum(v <= found[state][name] for v in values) / len(values)
            assert abs(rank - share) <= 2 * sketches.RANK_ERROR
    assert sum(r.rows for r in found.values()) == 400_000


def test_small_groups_are_exact_and_order_does_not_matter(spark):
    rng = random.Random(3)
    rows = [("A" if i % 2 else "B", None, float(rng.randrange(500))) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [sketches.spend_sketches(df.where(f"total_spend % 3 = {i}"), ("state",)) for i in (2, 0, 1)]
    merged = sketches.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("state",))
    got = {tuple(r) for r in sketches.thresholds_of(merged, ("state",)).drop("rows").collect()}
    assert got == {tuple(r)[:1] + tuple(r)[2:] for r in spend_thresholds(df).collect()}


def test_unknown_spends_empty_tables_and_null_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame([("A", None, None), ("A", None, nan), (None, None, 4.0), ("B", None, 2.0), ("B", None, None)], SCHEMA)
    stored = sketches.spend_sketches(df)
    twice = sketches.merge_sketches(stored, ("state",))
    got = {r.state: (r.rows, r.spend_75th_percentile) for r in sketches.thresholds_of(twice, ("state",)).collect()}
    assert got == {"A": (2, None), None: (1, 4.0), "B": (2, 2.0)}
    assert sketches.thresholds_of(sketches.merge_sketches(sketches.spend_sketches(df.where("false")))).isEmpty()
