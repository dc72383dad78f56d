"""Claim records made from lineitem, orders, customer and part."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrends.operators.canonical import add_normalized_ndc, add_quarter_start

# First header variant of each canonical column the tables can fill.
HEADERS = {
    "record_type": "Utilization Type",
    "state": "State",
    "ndc11": "NDC",
    "year": "Year",
    "quarter": "Quarter",
    "suppression_used": "Suppression Used",
    "product_name_fda10": "Product Name",
    "units_reimbursed": "Units Reimbursed",
    "prescriptions": "Number of Prescriptions",
    "total_amount": "Total Amount Reimbursed",
    "medicaid_amount": "Medicaid Amount Reimbursed",
    "non_medicaid_amount": "Non Medicaid Amount Reimbursed",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _line_items(spark: SparkSession, folder: str) -> DataFrame:
    owners = _table(spark, folder, "orders").join(
        _table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "c_nationkey")
    brands = _table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return (
        _table(spark, folder, "lineitem")
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    )


def _whole(value: Column) -> Column:
    """A number with two decimals as a whole number of hundredths."""
    return F.rint(value * 100).cast("bigint")


def _amounts() -> dict[str, Column]:
    """Total, and its parts split by the discount to the nearest cent, half up."""
    total = _whole(F.col("l_extendedprice"))
    other = F.floor((total * _whole(F.col("l_discount")) + 50) / 100)
    return {
        "total_amount": total / 100,
        "medicaid_amount": (total - other) / 100,
        "non_medicaid_amount": other / 100,
    }


def claims(spark: SparkSession, folder: str, sparse: bool = False) -> DataFrame:
    """One canonical claim per line item. Codes and product names are many to many.

    ``sparse`` takes the part's number for its code, which leaves most series a few quarters.
    """
    rows = _line_items(spark, folder).select(
        F.when(F.col("l_returnflag") == "R", "MCOU").otherwise("FFSU").alias("record_type"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state"),
        (F.col("p_partkey").cast("string") if sparse else F.col("p_brand")).alias("ndc11"),
        F.year("l_shipdate").alias("year"),
        F.quarter("l_shipdate").alias("quarter"),
        F.lit("false").alias("suppression_used"),
        F.col("p_type").alias("product_name_fda10"),
        F.col("l_quantity").alias("units_reimbursed"),
        F.lit(1).cast("bigint").alias("prescriptions"),
        *[column.alias(name) for name, column in _amounts().items()],
    )
    return add_normalized_ndc(add_quarter_start(rows))


def raw_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The claims as a CSV extract would hold them: raw headers, all text."""
    rows = claims(spark, folder)
    return rows.select(*[F.col(c).cast("string").alias(h) for c, h in HEADERS.items()])


def messy_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Raw text claims with faults in every field, by line number and status."""
    line = F.col("l_linenumber")
    quarter = F.quarter("l_shipdate")
    amounts = _amounts()
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    drift = (
        F.when(F.col("l_linestatus") == "F", 0.02).when(line == 2, 0.005).otherwise(0.0)
    )
    code = (
        F.when(line == 1, F.lit(None))
        .when(line == 2, "abc")
        .when(line == 3, F.lpad(F.col("l_partkey").cast("string"), 13, "7"))
        .otherwise(F.concat(F.col("p_brand"), F.lit("-80")))
    )
    rows = _line_items(spark, folder).select(
        F.lit(" MCOU ").alias("record_type"),
        F.concat(F.lit(" a"), F.col("c_nationkey").cast("string")).alias("state"),
        code.alias("ndc11"),
        F.when(line == 4, "n/a").otherwise(F.year("l_shipdate").cast("string")).alias("year"),
        (quarter + F.when(line == 5, 4).when(line == 6, -4).otherwise(0)).alias("quarter"),
        F.when(line == 7, F.lit(None)).otherwise("false").alias("suppression_used"),
        F.concat(F.col("p_brand"), F.lit(" ")).alias("product_name_fda10"),
        (F.col("l_quantity") * sign).alias("units_reimbursed"),
        F.when(line == 3, "x").otherwise("1").alias("prescriptions"),
        (amounts["total_amount"] * sign).alias("total_amount"),
        (amounts["medicaid_amount"] * sign + drift).alias("medicaid_amount"),
        F.when(line != 7, amounts["non_medicaid_amount"] * sign).alias("non_medicaid_amount"),
    )
    return rows.select(*[F.col(c).cast("string").alias(h) for c, h in HEADERS.items()])


BROKEN_HEADER = (
    "State", "NDC", "Year", "Quarter", "Product Name", "Units Reimbursed", "Number of Prescriptions",
    "Total Amount Reimbursed",
)

RECORDS_PER_FILE = 500_000


def export_with_broken_records(spark: SparkSession, folder: str, path: str, files: int = 8) -> None:
    """The claims as CSV text, with faults by line number.

    ``files`` is the least number of files; larger tables have one for each RECORDS_PER_FILE line
    items of either half, as a file is one task's sort. Records of line 1 lack their last two fields, those of line 2 have two more, and those of
    line 3 have a line break within a quoted name, which is no fault.
    """
    line = F.col("l_linenumber")
    fields = [
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.col("p_brand"), F.year("l_shipdate"),
        F.quarter("l_shipdate"), F.when(line == 3, F.concat(F.lit('"'), "p_type", F.lit('\n, net"'))).otherwise(F.col("p_type")),
        F.col("l_quantity").cast("int"), F.lit(1), F.col("l_extendedprice").cast("decimal(18,2)"),
    ]
    fields = [f.cast("string") for f in fields]
    files = max(files, 2 * ceil(_table(spark, folder, "lineitem").count() / RECORDS_PER_FILE))
    record = (
        F.when(line == 1, F.concat_ws(",", *fields[:-2]))
        .when(line == 2, F.concat_ws(",", *fields, F.lit("x"), F.lit("y")))
        .otherwise(F.concat_ws(",", *fields))
    )
    # files with line breaks, and files without any
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(files // 2)) + F.when(line == 3, files // 2).otherwise(0)
    rows = _line_items(spark, folder).select(record.alias("value"), part.cast("int").alias("part"), F.lit(1).alias("place"))
    heads = spark.range(files).select(
        F.lit(",".join(BROKEN_HEADER)).alias("value"), F.col("id").cast("int").alias("part"), F.lit(0).alias("place")
    )
    whole = rows.unionByName(heads).repartitionById(files, "part").sortWithinPartitions("place")
    whole.select("value").write.text(path)
    # the writer names its files .txt
    _move_files(spark, path, path, lambda name: name.removesuffix(".txt") + ".csv" if name.endswith(".txt") else None)


def _move_files(spark: SparkSession, source: str, target: str, named: Callable[[str], str | None]) -> int:
    """Rename files of a folder into another, each as ``named`` says unless that is None; how many."""
    java = spark._jvm.org.apache.hadoop.fs
    start, end = java.Path(source), java.Path(target)
    system = start.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(start):
        return 0
    system.mkdirs(end)
    moved = 0
    for status in system.listStatus(start):
        name = status.getPath()
        if (new := named(name.getName())) is not None:
            if not system.rename(name, java.Path(end, new)):
                raise OSError(f"{name.toString()} could not be moved to {target}")
            moved += 1
    return moved


def export_batches(rows: DataFrame, batch: Column, path: str) -> None:
    """Rows as CSV extracts, a folder for each batch number, from one pass over the rows."""
    rows.withColumn("batch", batch).write.partitionBy("batch").option("header", True).csv(path)


def deliver_batch(rows: DataFrame, path: str, number: int, target: str) -> None:
    """Move the extract of one batch into a folder; one without rows is a header alone."""
    name = lambda file: f"batch-{number}-{file}" if file.endswith(".csv") else None
    if not _move_files(rows.sparkSession, f"{path}/batch={number}", target, name):
        empty = rows.sparkSession.createDataFrame([], rows.schema)
        empty.write.mode("append").option("header", True).csv(target)
