import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sitegauge.session import local_session

    session = local_session("4", memory="6g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over one literal row and return the values."""
    from pyspark.sql import functions as F

    def run(*columns):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
        return row[0] if len(columns) == 1 else tuple(row)

    run.F = F
    return run
