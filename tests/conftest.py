import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def lines(spark):
    """A function that makes a table of lines from a text."""

    def make(text, file_idx=0):
        rows = [(file_idx, i // 3, i, t) for i, t in enumerate(text.strip("\n").split("\n"))]
        return spark.createDataFrame(rows, "file_idx int, split_start long, line_no long, line string")

    return make
