"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from suite.oracles import ORACLES
from suite.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    order = [list(types).index(c) for c in df.columns]
    expected = sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    assert sorted(tuple(map(plain, row)) for row in df.collect()) == expected
    assert expected


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == QUERIES["pipeline_risks"](spark, FOLDER).columns
    assert df.limit(1).count() == 1
