import pytest

from claimtrends.llm.common import prepare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
