from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted tuples of the given (or all) columns."""
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.fixture(scope="session")
def skewed(spark):
    """3,000 rows, one key holding half of them, one null key, two classes."""
    data = []
    for i in range(3000):
        key = None if i % 50 == 0 else ("hot" if i % 2 else f"k{i % 7}")
        data.append((i, key, int(i % 5 == 0 or i % 11 == 0), float((i * 37) % 101), i / 10.0))
    return spark.createDataFrame(data, "id bigint, g string, y int, x double, c double").repartition(4)
