import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftline.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "siftline-tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture
def col(spark):
    """Evaluate a Column function on a list of strings."""

    def run(values, fn):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [r["r"] for r in df.select("i", fn("t").alias("r")).orderBy("i").collect()]

    return run
