import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tesselith.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "2000"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
