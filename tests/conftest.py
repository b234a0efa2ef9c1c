import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkloom.session import BUILD_SETTINGS, configure  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         .config(map=BUILD_SETTINGS).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return configure(s)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def apply(spark):
    """Evaluate a column function over a list of strings, in order."""
    def run(fn, values):
        from pyspark.sql import functions as F
        rows = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
        return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]
    return run
