import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from listingmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate a column function over a list of values, in order."""
    from pyspark.sql import functions as F

    def run(values, fn, ddl="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {ddl}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]

    return run
