import pytest


@pytest.fixture(scope="package", autouse=True)
def small_exchanges(spark):
    """The tables here are small and the jobs many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
