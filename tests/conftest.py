import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-")
    session = build_session("tests", "local[8]", **{
        "spark.checkpoint.dir": f"file://{scratch}/shared", "spark.sql.warehouse.dir": f"file://{scratch}/warehouse",
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture
def one(spark):
    """Evaluate a column over one row of named values and return it as Python data."""
    def evaluate(column, **values):
        frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
        value = frame.select(column.alias("x")).first()["x"]
        return value.asDict() if hasattr(value, "asDict") else value

    return evaluate
