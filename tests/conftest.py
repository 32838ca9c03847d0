import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from lakeward.session import BASE_CONF  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="lakeward-test-ckpt-")
    b = SparkSession.builder.master("local[*]").appName("lakeward-tests")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = (b.config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", ckpt)
         .config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
