import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labelmill.operators import curate
from labelmill.plans.curation import curate_to, curated
from labelmill.sources import models
from labelmill.sources import samples as src
from tests.conftest import values


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'text,label\n"1,142 people, ""x""",fake_urgency\n"two\nlines",normal\n')
    got = values(src.read_samples(spark, p).orderBy("ord"), "text", "label")
    assert got == [('1,142 people, "x"', "fake_urgency"), ("two\nlines", "normal")]


def test_null_tokens(spark, tmp_path):
    p = write(tmp_path / "a.csv", "text,label\nNA,x\nok,\nnull,y\nfine,z\n")
    plain = values(src.read_samples(spark, p).orderBy("ord"), "text", "label")
    assert plain == [("NA", "x"), ("ok", None), ("null", "y"), ("fine", "z")]
    pandas_like = src.read_samples(spark, p, null_tokens=src.PANDAS_NULLS)
    assert values(curate.clean(pandas_like), "text", "label") == [("fine", "z")]


def test_missing_source_is_empty_only_on_request(spark, tmp_path):
    absent = str(tmp_path / "absent.csv")
    with pytest.raises(AnalysisException):
        src.read_samples(spark, absent)
    empty = src.read_samples(spark, absent, missing_ok=True)
    assert empty.columns == ["text", "label", "ord"] and empty.count() == 0


def test_file_order_survives_splitting(spark, tmp_path):
    """Rows keep their file order though the file is read in many small splits."""
    lines = "".join(f"t{i % 700},l{i}\n" for i in range(3000))
    p = write(tmp_path / "a.csv", "text,label\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = src.read_samples(spark, p, multi_line=False)
        assert df.rdd.getNumPartitions() > 4
        kept = curate.dedup_keep_first(curate.union_sources([df]))
        got = {r["text"]: r["label"] for r in kept.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"t{i}": f"l{i}" for i in range(700)}


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_write_and_read_back(spark, make, tmp_path, fmt):
    pairs = [('say "hi", you', "a"), ("  spaced  ", "b"), ("line\nbreak", "a"), ("back\\slash", "c"), ("é█", "d")]
    path = str(tmp_path / "out")
    src.write_samples(make(pairs).select("text", "label"), path, fmt)
    assert sorted(values(src.read_samples(spark, path, fmt), "text", "label")) == sorted(pairs)


def test_rewriting_a_source_in_place(spark, make, tmp_path):
    path = str(tmp_path / "corpus")
    src.write_samples(make([(f"t{i}", "ab"[i % 3 == 0]) for i in range(30)]).select("text", "label"), path)
    extra = src.literal_samples(spark, ["t0", "new one"], "a")
    counts = values(curate_to([src.read_samples(spark, path), extra], path))
    assert counts == [("a", 10), ("b", 10)]
    again = values(curate_to([src.read_samples(spark, path)], path))
    assert again == counts


def test_curating_twice_changes_nothing(spark, make):
    docs = make([(f"text {i % 50}", "xyz"[i % 7 % 3]) for i in range(120)]).drop("id")
    once = curated([docs])
    rows = sorted(values(once, "text", "label"))
    twice = curated([once.select("text", "label", "ord")])
    assert sorted(values(twice, "text", "label")) == rows


def test_error_report_file(spark, tmp_path):
    report = spark.createDataFrame(
        [(1, 'a "b", c ', "x", "y", 99.9, 0.1)],
        "id int, text string, true_label string, predicted_label string, confidence_pct double, true_class_prob double",
    )
    path = str(tmp_path / "errors")
    models.write_errors(report, path)
    header = "text,true_label,predicted_label,confidence_pct,true_class_prob\n"
    parts = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".csv")]
    bodies = [open(p, encoding="utf-8").read() for p in parts]
    assert all(b.startswith(header) for b in bodies)  # a part without rows is its header alone
    assert "".join(b.removeprefix(header) for b in bodies) == '"a ""b"", c ",x,y,99.9,0.1\n'


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    models.append_run(spark, path, "r", 1, {"f1_macro": 0.5, "accuracy": 1})
    models.append_run(spark, path, "r", 2, {"f1_macro": 0.75})
    got = sorted(values(models.read_runs(spark, path)))
    assert got == [("r", 1, "accuracy", 1.0), ("r", 1, "f1_macro", 0.5), ("r", 2, "f1_macro", 0.75)]


def test_spread_only_touches_small_scans(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartition(6).write.parquet(path)
    one = spark.read.parquet(path).coalesce(1)
    assert src.spread(one).rdd.getNumPartitions() == 4
    many = spark.range(100, numPartitions=9)
    assert src.spread(many) is many


def test_literal_sources_keep_list_order(spark):
    a = src.literal_samples(spark, ["one", "two", "one"], "a")
    b = src.literal_samples(spark, ["two", "three"], "b")
    kept = curate.dedup_keep_first(curate.union_sources([a, b]))
    assert sorted(values(kept, "text", "label")) == [("one", "a"), ("three", "b"), ("two", "a")]
    assert kept.where(F.col("source_rank") == 1).count() == 1


def test_one_of_two_paths_is_absent(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\none,x\ntwo,y\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "nope.csv")]
    assert src.read_samples(spark, paths, missing_ok=True).count() == 2
