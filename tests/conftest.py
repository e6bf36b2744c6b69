import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quantweave.session import get_spark
    shared = tmp_path_factory.mktemp("shared")
    s = get_spark("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                          "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(shared),
                                          "spark.sql.warehouse.dir": str(shared / "warehouse")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def market(spark):
    from quantweave.sources.market import Market
    return Market(spark, "/root/testdata/sf0.001")
