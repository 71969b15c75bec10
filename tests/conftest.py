import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("stored").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def messy(spark):
    """Twenty shipments: tariffs as text with gaps, some unreadable days, a constant and a nearly empty column."""
    rows = []
    for i in range(1, 21):
        tariff = None if i % 4 == 3 else f"€{i},07{i % 10}.25" if i % 2 else f"{i * 31.5}"
        day = "soon" if i % 4 == 0 else f"{3 + i % 9}/{i}/2023"
        rows.append((i, tariff, ("north", "south", "east", "west")[i % 4], day, 1, 1 if i == 20 else None))
    return spark.createDataFrame(
        rows, "id int, revenue string, region string, date string, constant_col int, sparse_col int"
    )
