from __future__ import annotations

import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from apiarium.shipping import ship

    scratch = tempfile.mkdtemp(prefix="apiarium-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.checkpoint.dir", f"file://{scratch}")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
    shutil.rmtree(scratch, ignore_errors=True)
