import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wareloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="wareloom-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate one column expression per literal input row."""
    def run(rows, schema, *columns):
        df = spark.createDataFrame(rows, schema)
        out = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
        return [r[0] if len(columns) == 1 else tuple(r) for r in out]
    return run
