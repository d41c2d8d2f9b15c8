import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ebbtide import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Readings of one or more entities from (age, value) lists."""
    def make(**entities):
        rows = [(e, float(a), None if v is None else float(v), i)
                for e, pts in entities.items() for i, (a, v) in enumerate(pts)]
        return spark.createDataFrame(rows, "entity string, age_hours double, value double, seq int")
    return make
