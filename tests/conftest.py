from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from linkpulse.session import configure


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("linkpulse-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
