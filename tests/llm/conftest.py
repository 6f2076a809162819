import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def make(spark):
    """DataFrame from rows and a DDL schema, spread over a few partitions."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return build
