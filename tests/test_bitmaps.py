"""Key figures from bitmaps against the same figures of the rows."""

import datetime as dt

import pytest

from claimtrends.operators import bitmaps
from claimtrends.operators.serve import kpi_summary
from claimtrends.sources import checkpoint_table

from conftest import quarter


@pytest.fixture(scope="module")
def claims(aggregates):
    made = [(f"S{n % 5}", f"{n * 7919 % 90_000:011d}", f"P{n % 3}", n % 9, float(n % 50)) for n in range(6000)]
    made += [("S1", None, "P", 1, 4.0), (None, "00000000001", "P", 2, 8.0), ("S9", None, None, 3, None)]
    return checkpoint_table(aggregates(made), "claims")


SUBSETS = {
    "all": (bitmaps.Subset(), "true"),
    "two": (bitmaps.Subset(("S1", "S3")), "state in ('S1', 'S3')"),
    "late": (bitmaps.Subset(first=quarter(6)), "quarter_start >= '2021-07-01'"),
    "both": (bitmaps.Subset(("S1", "S9"), quarter(1), quarter(3)),
             "state in ('S1', 'S9') and quarter_start between '2020-04-01' and '2020-10-01'"),
    "no code": (bitmaps.Subset(("S9",)), "state = 'S9'"),
    "none": (bitmaps.Subset(("X",)), "state = 'X'"),
}


def figures(row):
    return tuple(row[c] for c in ("total_spend", "unique_drugs", "states", "latest_quarter", "latest_month"))


def check(cells, claims):
    found = {r.subset: figures(r) for r in bitmaps.kpi_of(cells, {n: s for n, (s, _) in SUBSETS.items()}).collect()}
    assert found == {n: figures(kpi_summary(claims.where(test)).first()) for n, (_, test) in SUBSETS.items()}


def test_any_subset_is_counted_exactly(claims):
    numbers = checkpoint_table(bitmaps.code_numbers(claims), "numbers")
    codes = [r.number for r in numbers.collect()]
    assert sorted(codes) == list(range(1, claims.select("ndc11_normalized").distinct().count()))
    check(bitmaps.kpi_cells(claims, numbers), claims)


def test_new_claims_keep_old_numbers_and_add_cells(claims):
    old, new = claims.where("quarter_start < '2021-04-01'"), claims.where("quarter_start >= '2021-04-01'")
    numbers = checkpoint_table(bitmaps.code_numbers(old), "numbers")
    more = checkpoint_table(bitmaps.code_numbers(new, numbers), "more")
    before, after = (dict(map(tuple, n.collect())) for n in (numbers, more))
    assert before.items() <= after.items() and sorted(after.values()) == list(range(1, len(after) + 1))
    cells = checkpoint_table(bitmaps.kpi_cells(old, numbers), "cells")
    check(bitmaps.merge_cells(cells, bitmaps.kpi_cells(new, more)), claims)


def test_codes_beyond_one_block_and_repeated_merges(spark):
    df = spark.range(70_000).selectExpr(
        "'A' as state", "date'2020-01-01' as quarter_start", "lpad(cast(id as string), 11, '0') as ndc11_normalized",
        "1.0D as total_spend")
    numbers = checkpoint_table(bitmaps.code_numbers(df), "numbers")
    cells = checkpoint_table(bitmaps.kpi_cells(df, numbers), "cells")
    assert cells.count() == 3
    row = bitmaps.kpi_of(bitmaps.merge_cells(cells, cells), {"all": bitmaps.Subset()}).first()
    assert (row.unique_drugs, row.total_spend) == (70_000, 140_000.0)


def test_an_empty_table_has_zero_counts(claims):
    nobody = claims.where("false")
    numbers = checkpoint_table(bitmaps.code_numbers(nobody), "numbers")
    row = bitmaps.kpi_of(bitmaps.kpi_cells(nobody, numbers), {"all": bitmaps.Subset(last=dt.date(2030, 1, 1))}).first()
    assert figures(row) == (None, 0, 0, None, None)
