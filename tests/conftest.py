import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session, ship

    found = session("local[4]", "tests", spark_ui_enabled="false", spark_driver_memory="4g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    found.conf.set("spark.sql.shuffle.partitions", "4")
    found.sparkContext.setLogLevel("ERROR")
    yield ship(found)
    found.stop()


@pytest.fixture
def sf():
    return SF
