import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from groundline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on one string."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(fn(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]

    return run
