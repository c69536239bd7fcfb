import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def column(spark):
    """Value of a Column made from a text: column(fn, text, ...)."""

    def value(fn, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        rows = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
        return rows.select(fn(*(rows[n] for n in names)).alias("v")).first()["v"]

    return value
