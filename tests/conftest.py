import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("fathomline-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from fathomline.functions.workers import workers_import_package

    workers_import_package(session)
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF
