import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("webframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def evaluate(spark):
    """Evaluate an expression over rows given as tuples; returns the values."""

    def run(rows, names, build, schema=None):
        keyed = [(i, *r) for i, r in enumerate(rows)]
        fields = schema or [f"{n} string" for n in names]
        df = spark.createDataFrame(keyed, "i int, " + ", ".join(fields))
        return [r["out"] for r in df.select("i", build().alias("out")).orderBy("i").collect()]

    return run
