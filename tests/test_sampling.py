import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmill.operators import sampling
from tests.conftest import values


def order_key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


def labelled(spark, n, pick):
    return spark.createDataFrame([(i, pick(i)) for i in range(n)], "id bigint, label string")


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_balance_equals_sorting_each_class(spark, digits):
    pick = lambda i: "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else "low")
    df = labelled(spark, 1000, pick).unionByName(spark.createDataFrame([(5000, None)], df_schema))
    got = sorted(values(sampling.balance(df, bucket_digits=digits), "label", "id"))
    want = []
    for label in ("big", "mid", "low"):
        ids = sorted((i for i in range(1000) if pick(i) == label), key=order_key)
        want += [(label, i) for i in ids[:100]]
    assert got == sorted(want)


df_schema = "id bigint, label string"


def test_balance_of_nothing(spark):
    assert sampling.balance(spark.createDataFrame([], df_schema)).count() == 0


def test_balance_does_not_depend_on_partitioning(spark):
    df = labelled(spark, 600, lambda i: "ab"[i % 5 == 0])
    first = sorted(values(sampling.balance(df.repartition(1)), "id"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(values(sampling.balance(df.repartition(11)), "id")) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_another_seed_picks_other_rows(spark):
    df = labelled(spark, 600, lambda i: "ab"[i % 5 == 0])
    picks = [set(values(sampling.balance(df, seed=s).where("label = 'a'"), "id")) for s in (42, 43)]
    assert len(picks[0]) == len(picks[1]) == 120 and picks[0] != picks[1]


def test_known_quotas():
    sizes = {"disguised_ad": 146, "fake_urgency": 140, "hidden_cost": 143, "normal": 131}
    train = sampling.split_quotas(sizes)
    assert train == {"disguised_ad": 117, "fake_urgency": 112, "hidden_cost": 114, "normal": 105}
    assert sampling.split_quotas({"a": 6, "b": 6}) == {"a": 5, "b": 4}


def test_impossible_splits_are_refused():
    with pytest.raises(ValueError, match="fewer than 2"):
        sampling.split_quotas({"a": 10, "b": 1})
    with pytest.raises(ValueError, match="cannot hold"):
        sampling.split_quotas({"a": 2, "b": 2, "c": 2})


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(2, 5000), min_size=1, max_size=6), st.integers(1, 99))
def test_quotas_are_proportional(sizes, percent):
    total = sum(sizes.values())
    n_test = -(-total * percent // 100)
    if min(n_test, total - n_test) < len(sizes):
        return
    train = sampling.split_quotas(sizes, percent)
    assert sum(train.values()) == total - n_test
    for k, n in sizes.items():
        assert abs(train[k] - n * (total - n_test) / total) < 1
        assert 0 <= train[k] <= n


def test_split_is_disjoint_complete_and_exact(spark):
    df = labelled(spark, 900, lambda i: "big" if i % 3 else f"c{i % 5}")
    split = sampling.stratified_split(df)
    assert split.count() == split.select("id").distinct().count() == 900
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    train = {r["label"]: r["count"] for r in split.where("fold = 'train'").groupBy("label").count().collect()}
    assert train == sampling.split_quotas(sizes)
    for label, quota in train.items():
        ids = sorted((r["id"] for r in df.where(F.col("label") == label).collect()), key=order_key)
        got = {i for (i,) in values(split.where(f"label = '{label}' AND fold = 'train'"), "id")}
        assert got == set(ids[:quota])
