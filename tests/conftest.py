import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelmill.session import local_session  # noqa: E402
from labelmill.sources.samples import row_order  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Samples from (text, label) pairs; the list position is id and order."""

    def build(pairs):
        rows = [(i, t, l) for i, (t, l) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "id bigint, text string, label string")
        return df.withColumn("ord", row_order(F.col("id")))

    return build


def values(df, *columns):
    rows = df.select(*columns).collect() if columns else df.collect()
    return [tuple(r) for r in rows]
