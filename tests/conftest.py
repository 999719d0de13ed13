from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tillsight.session import configure  # noqa: E402

TEST_DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return str(TEST_DATA / os.environ.get("TEST_SF", "sf0.001"))


@pytest.fixture
def rows(spark):
    """Evaluate expressions over literal rows: rows(schema, values, *columns)."""

    def run(schema, values, *columns):
        df = spark.createDataFrame(values, schema)
        return [tuple(r) for r in df.select(*columns).collect()]

    return run
