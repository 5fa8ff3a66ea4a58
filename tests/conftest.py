import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from riskweave.session import session

    top = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": str(top / "shared"), "spark.local.dir": str(top / "local"), "spark.sql.warehouse.dir": str(top / "warehouse")}
    spark = session("local[4]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
