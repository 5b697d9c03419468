from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from talweg.session import session

    s = session("tests", "local[2]", 2, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "50", "spark.driver.memory": "2g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
