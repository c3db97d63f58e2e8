import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def skewed(spark):
    """Histories in which one key holds a third of the rows and the null key another third."""
    rows = []
    states = ["idle", "busy", "error", "idle", "dead", "busy", "success", "starting"]
    for i in range(1500):
        key = 7 if i % 3 == 0 else None if i % 3 == 1 else i % 100
        rows.append((key, (i * 37) % 1500 // 4, i, states[(i * i) % 8], float(i % 11)))
    return spark.createDataFrame(rows, "key int, t int, id int, state string, value double")
