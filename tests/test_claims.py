import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimtrends.sources import read_raw_csvs, stage_tables
from suite import claims as source
from suite.queries import QUERIES

ROWS = 400


@pytest.fixture
def folder(spark, tmp_path):
    """Line items of a hundred orders, four lines each, with what they join to."""
    items = [(i // 4, i % 7, 1 + i % 4, float(i % 9 + 1), 100.25 + i, 0.05, dt.date(1997, 1 + i % 12, 3), "RNA"[i % 3], "OF"[i % 2])
             for i in range(ROWS)]
    tables = {
        "customer": ([(i, i % 5) for i in range(10)], "c_custkey bigint, c_nationkey int"),
        "orders": ([(i, i % 10) for i in range(100)], "o_orderkey bigint, o_custkey bigint"),
        "part": ([(i, f"Brand#{i % 3 + 1}1", f"TYPE {i}") for i in range(7)], "p_partkey bigint, p_brand string, p_type string"),
        "lineitem": (items, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
                     " l_discount double, l_shipdate date, l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_files_of_an_extract_grow_in_number_not_in_size(spark, folder, tmp_path, monkeypatch):
    few, many = f"{tmp_path}/few", f"{tmp_path}/many"
    source.export_with_broken_records(spark, folder, few, files=2)
    monkeypatch.setattr(source, "RECORDS_PER_FILE", 20)
    source.export_with_broken_records(spark, folder, many, files=2)
    texts = {path: [f.read_text() for f in sorted((tmp_path / path).glob("*.csv"))] for path in ("few", "many")}
    assert len(texts["few"]) == 2 and len(texts["many"]) == 2 * ROWS // 20
    header = ",".join(source.BROKEN_HEADER)
    bodies = {}
    for path, files in texts.items():
        assert all(text.startswith(f"{header}\n") and text.count(header) == 1 for text in files)
        bodies[path] = sorted(line for text in files for line in text.split("\n")[1:] if line)
    assert bodies["few"] == bodies["many"]
    assert max(text.count("\n") for text in texts["many"]) < max(text.count("\n") for text in texts["few"]) / 4


def test_places_are_found_without_moving_whole_records(spark, tmp_path):
    from claimtrends.sources import read_checked_claims

    (tmp_path / "raw").mkdir()
    lines = ["State,NDC", *[f"CA,{i}" if i % 500 else f"CA,{i},extra" for i in range(1, 2001)]]
    (tmp_path / "raw" / "a.csv").write_text("\n".join(lines) + "\n")
    quarantine = read_checked_claims(spark, str(tmp_path / "raw")).quarantine
    plan = quarantine._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert [(r.record, r.raw) for r in quarantine.orderBy("record").collect()] == [(i, f"CA,{i},extra") for i in (500, 1000, 1500, 2000)]


def test_batches_are_made_by_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return str(value)

    text = counted.asNondeterministic()
    rows = spark.range(0, 90, 1, 3).select(text("id").alias("NDC"), F.when(F.col("id") % 9 > 0, F.lit("a,\"b\"")).alias("State"))
    batch = F.when(F.col("NDC").cast("int") % 3 == 0, 3).otherwise(1)
    source.export_batches(rows, batch, f"{tmp_path}/batches")
    held = []
    for number in (1, 2, 3):
        source.deliver_batch(rows, f"{tmp_path}/batches", number, f"{tmp_path}/raw")
        held.append({int(r.NDC) for r in read_raw_csvs(spark, f"{tmp_path}/raw").collect()})
    assert held == [{i for i in range(90) if i % 3}] * 2 + [set(range(90))]
    states = read_raw_csvs(spark, f"{tmp_path}/raw").groupBy("State").count().collect()
    assert {(r.State, r["count"]) for r in states} == {(None, 10), ('a,"b"', 80)}
    assert seen.value == 90


def test_incremental_query_makes_its_claims_once(spark, folder, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    text, whole = counted.asNondeterministic(), source.raw_claims
    monkeypatch.setattr(source, "raw_claims", lambda *a: whole(*a).withColumn("State", text("State")))
    with stage_tables(spark):
        found = QUERIES["pipeline_incremental"](spark, folder).count()
        assert seen.value == ROWS
        monkeypatch.undo()
        assert found == QUERIES["pipeline_risks"](spark, folder).count() > 0
