import random

import pytest
from pyspark.sql import functions as F

from labelmill.operators import curate, labels
from labelmill.operators.labels import Classes
from labelmill.scratch import materialize, with_row_key
from tests.conftest import values


def test_dedup_keeps_first_by_source_then_row(spark):
    rows = [(0, 0, "A", "x"), (0, 1, "a", "x"), (1, 0, "A", "y"), (1, 1, None, "y"), (1, 2, None, "z")]
    df = spark.createDataFrame(rows, "source_rank int, ord int, text string, label string")
    got = values(curate.dedup_keep_first(df), "text", "label")
    assert sorted(got, key=str) == sorted([("A", "x"), ("a", "x"), (None, "y")], key=str)
    assert values(curate.duplicates_removed(df)) == [(5, 3, 2)]


def test_duplicates_removed_without_nulls_and_on_nothing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("A",), ("a ",)], "text string")
    assert values(curate.duplicates_removed(df)) == [(4, 3, 1)]
    assert values(curate.duplicates_removed(df.limit(0))) == [(0, 0, 0)]


def test_dedup_with_one_text_in_a_third_of_the_rows(spark):
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("text"),
        F.col("id").alias("ord"),
        F.lit(0).alias("source_rank"),
    )
    kept = curate.dedup_keep_first(df)
    assert kept.count() == n - n // 3 + 1
    assert values(kept.where("text = 'hot'"), "ord") == [(1,)]


def test_union_keeps_priority_and_fills_missing_columns(spark):
    a = spark.createDataFrame([("t", "x")], "text string, label string")
    b = spark.createDataFrame([("u", "r")], "text string, role string")
    got = values(curate.union_sources([a, b]), "source_rank", "text", "label", "role")
    assert sorted(got) == [(0, "t", "x", None), (1, "u", None, "r")]


def test_clean_and_blank(make):
    df = make([("t", None), (None, "x"), ("NA", "x"), ("", "x"), ("  ", "x"), ("　\n", "x"), (" ok ", "x")])
    assert [t for (t,) in values(curate.clean(df).orderBy("id"), "text")] == ["NA", "", "  ", "　\n", " ok "]
    assert sorted(values(curate.drop_blank(df), "text")) == [(" ok ",), ("NA",), ("t",)]


def test_override_labels(spark, make):
    df = make([("a", "x"), ("b", "x"), ("c", "y")])
    over = spark.createDataFrame([("b", "z"), ("b", "w"), ("q", "z")], "text string, label string")
    got = values(curate.override_labels(df, over, "id").orderBy("id"), "text", "label")
    assert got == [("a", "x"), ("b", "w"), ("c", "y")]


def test_counts_and_profile(make):
    df = make([("first", "x"), ("b", "y"), ("c", "x"), ("d", None)])
    assert sorted(values(curate.class_counts(df))) == [("x", 2), ("y", 1)]
    assert values(curate.min_class_size(df)) == [(1,)]
    assert sorted(values(curate.profile(df.where("label = 'x'")))) == [("x", 2, "first")]


def test_labels_encode_decode_describe(spark, make):
    df = make([("a", "normal"), ("b", "disguised_ad"), ("c", "hidden_cost"), ("d", "fake_urgency"), ("e", "normal")])
    classes = labels.fit_classes(df)
    assert classes.names == ("disguised_ad", "fake_urgency", "hidden_cost", "normal")
    ids = labels.encode(df, classes)
    assert values(ids.orderBy("id"), "class_id") == [(3,), (0,), (2,), (1,), (3,)]
    back = labels.decode(ids.drop("label"), classes)
    assert sorted(values(back, "id", "class_name")) == sorted(values(df, "id", "label"))
    shown = labels.describe(df, curate.DESCRIPTIONS).where("id = 4")
    assert values(shown, "description") == [("✅ Normal transparent content",)]
    assert values(labels.describe(make([("a", "other")]), curate.DESCRIPTIONS), "description") == [(None,)]


def test_unseen_label_fails(make):
    with pytest.raises(Exception, match="unseen label: b"):
        labels.encode(make([("t", "b")]), Classes(("a",))).collect()


def test_too_many_classes_is_refused(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_CLASSES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        labels.fit_classes(spark.range(11).select(F.col("id").cast("string").alias("label")))


def test_no_text_is_sorted_or_shuffled(make):
    df = make([("a", "x"), ("b", "x"), ("a", "y")])
    for out in (curate.dedup_keep_first(df, priority=["ord"]), curate.profile(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Sort [" in line]
        assert not any("text" in line or "example" in line for line in lines)


def test_dropped_places_are_sent_in_bounded_rounds(spark, make):
    rng = random.Random(5)
    texts = [f"t{rng.randint(0, 40)}" for _ in range(400)]
    df = make([(t, "x") for t in texts]).repartition(9)
    want = sorted({texts.index(t) for t in texts})
    kept, counts = curate.dedup_with_counts(df, priority=["ord"])
    assert counts == {"rows_before": 400, "rows_after": len(want), "removed": 400 - len(want)}
    assert sorted(r["id"] for r in kept.collect()) == want
    keyed = with_row_key(df)
    first = keyed.groupBy("text").agg(F.min(F.struct("ord", "_row")).alias("f")).select("f._row")
    dropped = materialize(keyed.select("_row").join(first, "_row", "left_anti"))
    for limit in (1, 60, 150):
        left = curate.without_places(keyed, dropped, dropped.count(), max_rows=limit)
        assert sorted(r["id"] for r in left.collect()) == want


@pytest.mark.parametrize("max_runs", [1000, 0])
def test_positions_follow_sources_and_order(spark, make, max_runs):
    rng = random.Random(2)
    first = make([(f"a{i}", "x") for i in range(50)])
    second = make([(f"b{i}", "x") for i in range(30)]).repartition(4)  # lies out of order
    got = curate.with_positions(curate.union_sources([first, second]), max_runs).orderBy("position")
    assert [r["position"] for r in got.collect()] == list(range(80))
    assert [r["text"] for r in got.collect()] == [f"a{i}" for i in range(50)] + [f"b{i}" for i in range(30)]
    shuffled = make([(f"c{i}", "x") for i in sorted(range(40), key=lambda _: rng.random())])
    mixed = curate.with_positions(curate.union_sources([shuffled.orderBy("text")])).orderBy("position")
    assert [r["text"] for r in mixed.collect()] == [r["text"] for r in shuffled.orderBy("ord").collect()]
