import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sieveline.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def one(spark):
    """Evaluates a column function on a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(fn, values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("out"))
        return [r["out"] for r in df.orderBy("i").collect()]

    return run
