import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

AGGREGATE_SCHEMA = (
    "state string, ndc11_normalized string, product_name_fda10 string, quarter_start date,"
    " total_units double, total_scripts bigint, total_spend double, medicaid_spend double,"
    " non_medicaid_spend double"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("claimtrends-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("stages")))
    yield session
    session.stop()


def quarter(index: int) -> dt.date:
    """The start of the quarter ``index`` quarters after 2020-01-01."""
    return dt.date(2020 + index // 4, 3 * (index % 4) + 1, 1)


@pytest.fixture(scope="session")
def aggregates(spark):
    """Build an aggregates table from (state, ndc, product, quarter index, spend) rows."""

    def build(rows):
        full = [
            (s, n, p, quarter(q), None if v is None else v / 2, 1, v, None, None)
            for s, n, p, q, v in rows
        ]
        return spark.createDataFrame(full, AGGREGATE_SCHEMA)

    return build


def series(values, state="CA", ndc="1", product="A"):
    return [(state, ndc, product, q, v) for q, v in enumerate(values)]


def column(df, name, *order):
    return [row[name] for row in df.orderBy(*(order or ("quarter_start",))).collect()]
