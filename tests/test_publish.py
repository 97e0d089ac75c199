import json
import os

import pytest
from pyspark.sql import functions as F

from labelmill.operators import naive_bayes, subwords, tokens
from labelmill.operators.labels import Classes
from labelmill.plans import scoring
from labelmill.scratch import with_row_key
from labelmill.sources import models
from labelmill.sources import publish as pub
from labelmill.sources import samples as src
from labelmill.streaming import score_stream as streams
from tests.conftest import values


def broken(df, column):
    return df.withColumn(column, F.when(F.rand() >= 0, F.raise_error(F.lit("a failing write")).cast("string")))


def test_a_failing_write_leaves_the_corpus_as_it_was(spark, make, tmp_path):
    path = str(tmp_path / "corpus")
    src.write_samples(make([("a", "x"), ("b", "y")]).select("text", "label"), path)
    with pytest.raises(Exception, match="failing write"):
        src.write_samples(broken(src.read_samples(spark, path).select("text", "label"), "label"), path)
    assert sorted(values(src.read_samples(spark, path), "text", "label")) == [("a", "x"), ("b", "y")]
    # a writer that dies before the marker is replaced leaves a version nobody follows
    with pytest.raises(KeyError):
        pub.publish(spark, path, lambda folder: (spark.range(3).write.csv(folder), {}["gone"]))
    assert sorted(values(src.read_samples(spark, path), "text", "label")) == [("a", "x"), ("b", "y")]


def test_a_running_reader_keeps_its_version(spark, make, tmp_path):
    path = str(tmp_path / "corpus")
    src.write_samples(make([("old", "x")]).select("text", "label"), path)
    reader = src.read_samples(spark, path)
    src.write_samples(make([("new", "x")]).select("text", "label"), path)
    assert values(reader, "text") == [("old",)] and values(src.read_samples(spark, path), "text") == [("new",)]
    src.write_samples(make([("newer", "x")]).select("text", "label"), path)
    versions = [n for n in os.listdir(path) if n.startswith(pub.VERSION)]
    assert len(versions) == 2 and not [n for n in os.listdir(path) if n.startswith(pub.MARKER + ".")]


def test_a_plain_file_and_a_plain_folder_become_versions(spark, make, tmp_path):
    file = tmp_path / "corpus.csv"
    file.write_text("text,label\na,x\n")
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "part.csv").write_text("text,label\na,x\n")
    for path in (str(file), str(folder)):
        read = src.read_samples(spark, path).select(F.upper("text").alias("text"), "label")
        src.write_samples(read, path)
        assert values(src.read_samples(spark, path), "text", "label") == [("A", "x")]
    os.rename(file, str(file) + pub.ASIDE)  # what a crash between the two renames leaves
    assert pub.current(spark, str(file)) == str(file) + pub.ASIDE
    assert pub.current(spark, str(tmp_path / "none")) == str(tmp_path / "none")


def small_model(make, names=("x", "y")):
    classes = Classes(names)
    train = make([("good cheap", names[0]), ("bad bad", names[1])]).withColumn("class_id", F.col("id").cast("int"))
    return naive_bayes.fit(train, classes)


def test_a_failing_save_never_mixes_two_models(spark, make, tmp_path):
    from dataclasses import replace

    path = str(tmp_path / "model")
    models.save_naive_bayes(small_model(make), path)
    other = small_model(make, ("p", "q"))
    with pytest.raises(Exception, match="failing write"):
        models.save_naive_bayes(replace(other, tokens=broken(other.tokens, "token")), path)
    loaded = models.load_naive_bayes(spark, path)
    assert loaded.classes.names == ("x", "y")
    models.save_naive_bayes(loaded, path)
    again = models.load_naive_bayes(spark, path)
    assert sorted(values(again.tokens, "token")) == [("bad",), ("cheap",), ("good",)]


def test_a_candidate_logged_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    models.append_run(spark, path, "r", 1, {"f1_macro": 0.5, "accuracy": 1})
    models.append_run(spark, path, "s", 1, {"f1_macro": 0.1})
    models.append_run(spark, path, "r", 2, {"f1_macro": 0.75})
    models.append_run(spark, path, "r", 1, {"f1_macro": 0.6})
    got = sorted(values(models.read_runs(spark, path), "run_id", "candidate", "metric", "value"))
    assert got == [("r", 1, "f1_macro", 0.6), ("r", 2, "f1_macro", 0.75), ("s", 1, "f1_macro", 0.1)]


def test_many_candidates_are_logged_in_few_folders(spark, tmp_path):
    path = tmp_path / "runs"
    runs = spark.range(300).selectExpr("'r' AS run_id", "cast(id AS int) AS candidate", "'f1_macro' AS metric", "id / 2D AS value")
    models.log_runs(runs, str(path))
    models.log_runs(runs.where("candidate < 100").withColumn("value", F.lit(-1.0)), str(path))
    assert len([f for f in path.rglob("*") if f.is_dir()]) == 2
    got = {c: v for _, c, _, v in values(models.read_runs(spark, str(path)))}
    assert got == {c: -1.0 if c < 100 else c / 2 for c in range(300)}


REPEATED = [(1, "good cheap"), (1, "bad"), (None, "good"), (None, "bad bad"), (2, "good"), (2, "good")]


@pytest.mark.parametrize("max_bytes", [1 << 28, 0])
def test_rows_that_share_an_id_are_scored_apart(spark, make, max_bytes):
    df = spark.createDataFrame(REPEATED, "id int, text string")
    scores = naive_bayes.class_scores(df, small_model(make), ["id"], max_bytes=max_bytes)
    got = sorted((str(i), s[0] > s[1]) for i, s in values(scores))
    assert got == sorted((str(i), "good" in t) for i, t in REPEATED)


def test_rows_that_share_an_id_are_encoded_apart(spark):
    df = spark.createDataFrame(REPEATED, "id int, text string")
    vocab = spark.createDataFrame([("good", 4), ("cheap", 5), ("bad", 6)], "piece string, token_id int")
    ids = {"good": 4, "cheap": 5, "bad": 6}
    want = sorted((str(i), [ids[w] for w in t.split()]) for i, t in REPEATED)
    assert sorted((str(i), p) for i, p in values(subwords.subwords(df, vocab))) == want
    encoded = tokens.encode_ids(df, vocab.withColumnRenamed("piece", "token"))
    assert sorted((str(i), p) for i, p in values(encoded)) == [(i, [2, *p, 3]) for i, p in want]


def test_row_keys_are_unique_and_stay(spark):
    df = with_row_key(spark.createDataFrame([("x",)] * 50, "t string").repartition(7))
    first, second = ([r["_row"] for r in df.collect()] for _ in range(2))
    assert len(set(first)) == 50 and sorted(first) == sorted(second)


def test_answers_and_rejects_are_keyed_and_replayed_once(spark, make, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    lines = [json.dumps({"key": f"k{i}", "text": "good" if i % 2 else "bad"}) for i in range(10)]
    lines += ['{"text": "good"}', '{"text": ""}', '{"key": "b", "text": 5}', "no json", '{"key": 7, "text": "bad"}']
    spark.createDataFrame([(v,) for v in lines], "value string").repartition(3).write.text(inbox)
    model = small_model(make)

    def run():
        def scorer(texts):
            return scoring.predict(texts, model, ["key"], skip_blank=False)

        streams.answer_requests(spark.readStream.text(inbox), scorer, out, checkpoint).awaitTermination()
        answers = spark.read.json(f"{out}/answers/batch=*")
        rejects = spark.read.json(f"{out}/rejects/batch=*")
        return {r["key"]: r["prediction"] for r in answers.collect()}, sorted(values(rejects, "value", "key")), answers.count()

    answers, rejects, n = run()
    assert n == len(answers) == 13
    assert {k: v for k, v in answers.items() if k.startswith("k")} == {f"k{i}": "x" if i % 2 else "y" for i in range(10)}
    assert answers["7"] == "y" and sum(k.startswith("batch 0:") for k in answers) == 2
    assert [v for v, _ in rejects] == ["no json", '{"key": "b", "text": 5}'] and rejects[1][1] == "b"
    os.remove(f"{checkpoint}/commits/0")  # the batch is replayed, as after a failure
    if os.path.exists(f"{checkpoint}/commits/.0.crc"):
        os.remove(f"{checkpoint}/commits/.0.crc")
    assert run() == (answers, rejects, n)
