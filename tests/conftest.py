from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vexel.session import session

    shared = tmp_path_factory.mktemp("shared")
    out = session("local[4]", "tests", **{"spark.checkpoint.dir": str(shared), "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    yield out
    out.stop()
