import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate())
    yield session
    session.stop()
