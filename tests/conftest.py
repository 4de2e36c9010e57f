import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearth.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    session = build_session("hearth-tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named strings."""

    def value(expression, **columns):
        schema = ", ".join(f"{n} string" for n in columns) or "x string"
        row = tuple(columns.values()) or (None,)
        return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]

    return value
