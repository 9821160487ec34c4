import pytest


@pytest.fixture(autouse=True)
def small_batches(spark):
    """Groups and runs of rows then go over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
