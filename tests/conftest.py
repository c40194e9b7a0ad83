import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crowdlens.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Values of one row: one(F.lit(1) + 1) -> 2."""
    def evaluate(*columns):
        row = spark.range(1).select(*[column.alias(f"c{i}") for i, column in enumerate(columns)]).head()
        return row[0] if len(columns) == 1 else tuple(row)
    return evaluate
