import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))

from tablewatch.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [("a", 25.0, 50000.0, "eng"), ("b", 30.0, 60000.0, "eng"), ("c", 35.0, 70000.0, "sales"),
         ("d", 40.0, 80000.0, "sales"), ("e", 45.0, 90000.0, "eng")],
        "name STRING, age DOUBLE, salary DOUBLE, dept STRING",
    )


def column(spark, values, dtype="DOUBLE"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")
