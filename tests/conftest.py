import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    build = SparkSession.builder.master("local[4]")
    for key, value in {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}.items():
        build = build.config(key, value)
    session = build.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
