"""Every registered query on the smallest driver tables, against its SQL in DuckDB."""

import os

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tools import check

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    return check.duck(SMOKE_DIR)


@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    verdict = check.compare(queries()[name](spark, SMOKE_DIR), duck.execute(oracle_sql()[name]))
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", ["lr_predict", "model_roundtrip"])
def test_logistic_queries(spark, name):
    got = queries()[name](spark, SMOKE_DIR).collect()
    right = sum(r["label"] == r["prediction"] for r in got)
    assert len(got) == 38 and right / len(got) > 0.7


def test_stream_of_a_table_of_many_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["stream_score"](spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(queries()["stream_score"](spark, SMOKE_DIR).collect())


def test_entry(spark):
    assert entry(spark).columns == ["section", "class", "precision", "recall", "f1", "support"]
