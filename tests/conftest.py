from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from papyra.session import session

    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": "/tmp/papyra-tests/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
