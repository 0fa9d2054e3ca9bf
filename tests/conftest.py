import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("LAKEMART_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lakemart.session import configure

    s = (SparkSession.builder.master("local[*]").appName("lakemart-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # the tests' days are a few rows each: without this one task would write all folders of a table
         .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
