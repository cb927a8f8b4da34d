import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "labelweave-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def col(spark):
    """Evaluate one expression over one-column rows."""

    def run(values, schema, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
        rows = df.select("i", expression.alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
