import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session
    session = local_session("quillspark-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def column(spark):
    """Evaluate a column function on a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        rows = df.select("id", fn(F.col("t")).alias("x")).orderBy("id").collect()
        return [r["x"] for r in rows]
    return run
