import pytest
from pyspark.sql import functions as F

from claimtrends.sources import Conflict, Store


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_a_failed_build_leaves_the_former_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace("t", spark.range(3))
    with pytest.raises(Exception, match="boom"):
        store.replace("t", spark.range(9).withColumn("id", F.raise_error(F.lit("boom")).cast("long")))
    assert ids(store.read("t")) == [0, 1, 2] and store.numbers() == [1]
    # a table may be replaced by a frame that reads it
    store.replace("t", store.read("t").withColumn("id", F.col("id") + 10))
    assert ids(store.read("t")) == [10, 11, 12] and ids(store.read("t", 1)) == [0, 1, 2]


def test_partitions_are_replaced_together_over_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(12).withColumn("p", F.format_string("%02d", F.col("id") % 3))
    first = store.publish([store.write("a", rows, ("p",)), store.write("b", rows, ("p",))], store.commit())
    part = store.write("a", rows.where("p = '01'").withColumn("id", F.col("id") + 100), ("p",))
    assert sorted(part.folders) == ["p=01/"] and part.rows == 4
    assert ids(store.read("a")) == list(range(12))  # not published yet
    second = store.publish([part], first, {"inputs": {"x": [1, 2]}}, whole=False)
    assert ids(store.read("a")) == sorted([0, 3, 6, 9, 2, 5, 8, 11, 101, 104, 107, 110])
    assert ids(store.read("b")) == list(range(12)) and store.commit().note == {"inputs": {"x": [1, 2]}}
    assert store.read("a").schema == rows.schema.add("p", "string") or store.read("a").columns == ["id", "p"]
    assert ids(store.read("a", folders=["p=01/"])) == [101, 104, 107, 110]
    plan = store.read("a").where("p = '02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    with pytest.raises(Conflict):
        store.publish([part], first)
    assert store.commit().number == second.number == 2


def test_a_commit_cut_short_was_never_there(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace("t", spark.range(2))
    (tmp_path / "s" / "_versions" / "000000000002.json").write_text('{"tables": {"t"')
    assert store.commit().number == 1 and ids(store.read("t")) == [0, 1]
    store.replace("t", spark.range(5))
    assert store.commit().number == 3 and store.read("t").count() == 5
    with pytest.raises(KeyError):
        store.read("absent")


def test_expire_keeps_what_the_newest_versions_hold(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(4).withColumn("p", F.col("id") % 2)
    base = store.publish([store.write("t", rows, ("p",))], store.commit())
    for n in (1, 2):
        part = store.write("t", rows.where("p = 0").withColumn("id", F.col("id") + 10 * n), ("p",))
        base = store.publish([part], base, whole=False)
    store.write("t", rows, ("p",))  # of a build that never ended
    assert store.expire(keep=1) == 4
    assert store.numbers() == [3] and ids(store.read("t")) == [1, 3, 20, 22]


def test_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace("t", spark.range(0).withColumn("p", F.lit("x")), ("p",))
    assert store.read("t").columns == ["id", "p"] and store.read("t").count() == 0
    assert store.commit().number == 1 and Store(spark, str(tmp_path / "none")).commit().number == 0
