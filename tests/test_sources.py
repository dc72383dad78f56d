import pytest
from pyspark.sql import functions as F

from claimtrends.columns import FORECAST_SCHEMA
from claimtrends.sources import (
    checkpoint_table, configure, export_csv, load_forecasts, materialize, read_claims, read_parquet,
    read_checked_claims, read_raw_csvs, register_views, save_forecasts, shared_folder, stage_counts, stage_tables,
    store, write_parquet,
)
from claimtrends.sources import session as session_module


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_reordered_header_and_missing_column(spark, tmp_path):
    folder = write(
        tmp_path / "with space",
        a=["State,NDC,Year", "CA,0002,2024"],
        b=["Year,State,NDC", "2023,TX,0003"],
        c=["NDC,Year", "0004,2022"],
    )
    rows = read_raw_csvs(spark, folder).select("State", "NDC", "Year").collect()
    assert sorted(rows, key=lambda r: r.NDC) == [
        ("CA", "0002", "2024"), ("TX", "0003", "2023"), (None, "0004", "2022"),
    ]


def test_each_header_is_mapped_on_its_own(spark, tmp_path):
    folder = write(
        tmp_path / "raw",
        a=["State,No. of Prescriptions", "ca,1"],
        b=["State Code,Scripts", "tx,2.0"],
    )
    rows = read_claims(spark, folder).collect()
    assert sorted((r.state, r.prescriptions) for r in rows) == [("CA", 1), ("TX", 2)]


def test_files_with_one_header_share_a_scan(spark, tmp_path):
    files = {f"f{i}": ["State,NDC", f"CA,{i}"] for i in range(5)}
    rows = read_raw_csvs(spark, write(tmp_path / "raw", **files))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert rows.count() == 5


def test_leading_zeros_and_wide_codes_survive(spark, tmp_path):
    folder = write(tmp_path / "raw", a=["NDC", "00012"], b=["NDC", "123456789012345678901"])
    codes = {r.NDC for r in read_raw_csvs(spark, folder).collect()}
    assert codes == {"00012", "123456789012345678901"}


def test_other_files_are_ignored(spark, tmp_path):
    folder = write(tmp_path / "raw", a=["State", "CA"])
    (tmp_path / "raw" / "notes.txt").write_text("State\nXX\n")
    assert read_raw_csvs(spark, folder).count() == 1


def test_uniform_headers_are_checked_while_scanning(spark, tmp_path):
    same = write(tmp_path / "same", a=["State,NDC", "CA,1"], b=["State,NDC", "TX,2"])
    assert read_raw_csvs(spark, same, uniform=True).count() == 2
    mixed = write(tmp_path / "mixed", a=["State,NDC", "CA,1"], b=["NDC,State", "2,TX"])
    with pytest.raises(Exception, match="(?i)header"):
        read_raw_csvs(spark, mixed, uniform=True).collect()


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_raw_csvs(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_raw_csvs(spark, str(tmp_path / "empty"))


def test_empty_files_are_skipped(spark, tmp_path):
    folder = write(tmp_path / "raw", a=["State", "CA"])
    (tmp_path / "raw" / "empty.csv").write_text("")
    assert read_raw_csvs(spark, folder).collect() == [("CA",)]
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "empty.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        read_raw_csvs(spark, str(tmp_path / "blank"))


def test_export_has_a_header(spark, tmp_path):
    path = str(tmp_path / "out")
    export_csv(spark.createDataFrame([("CA", 'a "b", c')], "state string, name string"), path)
    assert spark.read.option("header", True).csv(path).collect() == [("CA", 'a "b", c')]


def test_parquet_overwrites_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(spark.range(5).withColumn("state", F.lit("CA")), path)
    write_parquet(spark.range(40).withColumn("state", F.concat(F.lit("S"), F.col("id") % 4)), path, ("state",))
    back = read_parquet(spark, path)
    assert back.count() == 40
    assert "PartitionFilters: [isnotnull(state" in back.where("state = 'S1'")._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "t" / "state=S1").glob("*.parquet"))) == 1


def test_materialize_builds_once_and_repairs_a_broken_write(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert materialize(spark, path, build).count() == 3
    assert materialize(spark, path, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "m" / "_SUCCESS").unlink()
    assert materialize(spark, path, build).count() == 3
    assert len(calls) == 2


def test_forecasts_absent_and_stored(spark, tmp_path):
    empty = load_forecasts(spark, str(tmp_path / "none"))
    assert empty.schema == FORECAST_SCHEMA and empty.count() == 0
    one = spark.createDataFrame([("CA", "1") + (None,) * 9], FORECAST_SCHEMA)
    save_forecasts(one, str(tmp_path / "f"))
    assert load_forecasts(spark, str(tmp_path / "f")).collect() == one.collect()


def test_views_answer_parameterized_sql(spark):
    table = spark.createDataFrame([("CA", 1.0), ("TX", 2.0)], "state string, total_spend double")
    register_views(spark, table, table, table)
    query = "SELECT sum(total_spend) AS s FROM combined_data WHERE state = :state"
    assert spark.sql(query, args={"state": "TX"}).first().s == 2.0
    assert spark.sql(query, args={"state": "x' OR '1'='1"}).first().s is None


def test_stage_counts(spark):
    counts = stage_counts({"raw": spark.range(5), "clean": spark.range(0)})
    assert {(r.stage, r.row_count) for r in counts.collect()} == {("raw", 5), ("clean", 0)}


def test_checkpoint_table_cuts_the_plan_and_knows_its_size(spark):
    stored = checkpoint_table(spark.range(100).groupBy(F.col("id") % 7).count(), "small")
    assert "Aggregate" not in stored._jdf.queryExecution().optimizedPlan().toString()
    assert stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10_000


class _Context:
    def __init__(self, master, conf, checkpoint=None):
        self.master, self._conf, self._checkpoint = master, conf, checkpoint

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._checkpoint

    def setCheckpointDir(self, path):
        self._checkpoint = path


class _Session:
    def __init__(self, context):
        self.sparkContext = context
        self.conf = self

    def get(self, name, default):
        return default


def test_shared_folder_is_the_clusters():
    assert shared_folder(_Session(_Context("yarn", {"spark.checkpoint.dir": "hdfs:///x/"}))) == "hdfs:///x"
    assert shared_folder(_Session(_Context("yarn", {}, "hdfs:///y"))) == "hdfs:///y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session(_Context("yarn", {})))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session(_Context("local[2]", {})))


def test_stage_tables_go_with_their_scope(spark, tmp_path):
    from pathlib import Path
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    kept = checkpoint_table(spark.range(4), "kept")
    with stage_tables(spark):
        inner = checkpoint_table(spark.range(9), "inner")
        assert inner.stored_rows == inner.count() == 9
        assert len(set(folder.iterdir()) - before) == 2
    assert len(set(folder.iterdir()) - before) == 1 and kept.count() == 4


def test_folder_columns_keep_type_and_place(spark, tmp_path):
    rows = spark.createDataFrame([("05", 1.5), ("5", 2.5), (None, 3.5)], "state string, spend double")
    back = store(rows, str(tmp_path / "t"), partition_by=("state",))
    assert back.schema == rows.schema and back.stored_rows == 3
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert "PartitionFilters: [isnotnull(state" in back.where("state = '05'")._jdf.queryExecution().toString()


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    files = {f"f{i}": ["State,NDC" if i % 2 else "NDC,State", f"{i},{i}"] for i in range(200)}
    files["empty"] = [""]
    folder = write(tmp_path / "many", **files)
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        rows = read_raw_csvs(spark, folder)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4 and rows.count() == 200


def test_configure_sets_runtime_settings(spark):
    before = {k: spark.conf.get(k) for k in session_module.SETTINGS}
    try:
        assert configure(spark, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"}) is spark
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "64m"
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_broken_records_are_set_apart(spark, tmp_path):
    folder = write(
        tmp_path / "raw",
        a=["State,NDC,Product Name", "CA,1,x", "TX,2", "", 'NY,3,"two', 'lines, one name"', "CA,4,y,z", "WA,5,w"],
        b=["State,NDC", "OR,6", 'OR,"7'],
        c=['State,"National', 'Drug Code",Product Name', "NV,8,v", "NV,9"],
        d=["State,NDC,Product Name", 'CA,10,5\\" tape', "CA,11", "CA,12,q"],
    )
    checked = read_checked_claims(spark, folder)
    kept = {(r.state, r.ndc11, r.product_name_fda10) for r in checked.claims.collect()}
    assert kept == {("CA", "1", "x"), ("NY", "3", 'two\nlines, one name'), ("WA", "5", "w"), ("OR", "6", None),
                    ("OR", "7\n", None), ("NV", None, "v"), ("CA", "10", '5\\" tape'), ("CA", "12", "q")}
    broken = {(r.file.rsplit("/", 1)[1], r.block_start, r.record, r.fields, r.raw) for r in checked.quarantine.collect()}
    assert broken == {("a.csv", 0, 2, 3, "TX,2"), ("a.csv", 0, 4, 3, "CA,4,y,z"), ("c.csv", 0, 2, 3, "NV,9"), ("d.csv", 0, 2, 3, "CA,11")}
    assert checked.claims.count() + checked.quarantine.count() == 5 + 2 + 2 + 3
    # without the check the short row is filled and the long one cut
    plain = {(r.state, r.product_name_fda10) for r in read_claims(spark, folder).collect()}
    assert ("TX", None) in plain and ("CA", "y") in plain


def test_places_of_broken_records_in_parts_of_a_file(spark, tmp_path):
    lines = ["State,NDC", *[f"CA,{i}" if i % 1000 else f"CA,{i},extra" for i in range(1, 5001)]]
    folder = write(tmp_path / "raw", a=lines, b=["State,NDC", "TX,1"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        checked = read_checked_claims(spark, folder)
        found = checked.quarantine.orderBy("block_start", "record").collect()
        assert checked.claims.count() == 4996
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.raw for r in found] == [f"CA,{i},extra" for i in range(1000, 5001, 1000)]
    data = (tmp_path / "raw" / "a.csv").read_bytes()
    for r in found:
        # a part begins with the first line that starts after its first byte
        begin = data.index(b"\n", r.block_start - 1) + 1 if r.block_start else data.index(b"\n") + 1
        assert data[begin:].decode().split("\n")[r.record - 1] == r.raw
    assert len({r.block_start for r in found}) > 1


def test_a_whole_folder_has_no_quarantine(spark, tmp_path):
    checked = read_checked_claims(spark, write(tmp_path / "raw", a=["State,NDC", "CA,1"]))
    assert checked.quarantine.count() == 0 and checked.claims.count() == 1
    with pytest.raises(FileNotFoundError):
        read_checked_claims(spark, str(tmp_path / "absent"))
