import duckdb
import pytest

from claimtrends.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(llm, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = base.execute(ORACLES[name]).df()
    got = QUERIES[name](llm, FOLDER).toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and len(got) == len(want) > 0
    key = lambda df: sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)))
    assert key(got) == key(want)
