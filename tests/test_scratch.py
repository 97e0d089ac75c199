import pytest
from pyspark.sql import functions as F

from labelmill import scratch
from tests.conftest import values


def skewed(spark, n=9000):
    """A third of all rows share one key; keys 0..49 are known, the others are not."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 60))
    return spark.range(n).select("id", F.when(F.col("id") == 7, F.lit(None)).otherwise(key).alias("key"))


def dimension(spark):
    return spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", 999)], "key string, v bigint")
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_both_join_forms_agree(spark, how):
    facts, dim = skewed(spark), scratch.materialize(dimension(spark))
    small = scratch.lookup_join(facts, dim, "key", "id", how)
    large = scratch.lookup_join(facts, dim, "key", "id", how, max_bytes=0)
    assert "BroadcastHashJoin" in plan(small)
    assert sorted(values(small, "id", "v"), key=str) == sorted(values(large, "id", "v"), key=str)
    assert small.count() == (9000 if how == "left" else large.count())


def test_hot_key_is_found_and_spread(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts, dim = skewed(spark), dimension(spark)
        assert "hot" in scratch.hot_keys(facts, "key")
        joined = scratch.shuffled_lookup(facts, dim, "key", "id")
        assert "_salt" in plan(joined) and "BroadcastHashJoin" not in plan(joined)
        sizes = joined.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_hot_keys_in_an_even_table(spark):
    even = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    assert scratch.hot_keys(even, "key") == []


def test_size_estimate_grows_with_the_strings(spark):
    small = spark.createDataFrame([("a", [1.0])], "token string, weights array<double>")
    large = spark.createDataFrame([("a" * 10_000, [1.0])], "token string, weights array<double>")
    assert 10_000 > scratch.table_bytes(small) > 0
    assert scratch.table_bytes(large) > 10_000
    assert scratch.table_bytes(small.limit(0)) == 0


class Session:
    """Stands in for a session: its master and its settings."""

    def __init__(self, master, **settings):
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})
        self.conf = settings


def test_scratch_folder_follows_the_setting():
    shared = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch.scratch_dir(shared) == "hdfs:///shared/labelmill/app-1"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session("yarn"))
    local = Session("local[2]")
    assert scratch.scratch_dir(local) == scratch.scratch_dir(local)


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(3).select("id", F.lit("x").alias("t"), F.array("id").alias("a"))
    back = scratch.materialize(df, "demo")
    assert back.columns == df.columns and sorted(values(back)) == sorted(values(df))
    base = scratch.scratch_dir(spark).split("://")[-1]
    assert all(base.removeprefix("file:").rstrip("/") in f for f in back.inputFiles())
