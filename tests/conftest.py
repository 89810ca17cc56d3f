import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brevia.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        8, 8, **{"spark.driver.memory": "8g", "spark.checkpoint.dir": str(shared)}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Apply a column function to one text."""
    from pyspark.sql import functions as F

    def apply(rule, text):
        row = spark.createDataFrame([(text,)], "text string").select(rule(F.col("text"))).first()
        return row[0]

    return apply
