import math
from collections import Counter

import pytest
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from labelmill.operators import evaluate, labels, logistic, naive_bayes, scoring, selection
from labelmill.operators.labels import Classes
from labelmill.plans import scoring as score_plan
from labelmill.plans import training
from labelmill.scratch import materialize
from labelmill.sources import models, requests
from labelmill.streaming import score_stream as streams
from tests.conftest import values

TRAIN = [
    ("hurry only two left", "urgent"),
    ("hurry offer ends", "urgent"),
    ("fee added at checkout", "cost"),
    ("extra fee at delivery", "cost"),
    ("extra charges added", "cost"),
    ("standard shipping", "normal"),
]


def fitted(make, **knobs):
    df = make(TRAIN)
    classes = labels.fit_classes(df)
    return naive_bayes.fit(labels.encode(df, classes), classes, **knobs)


def by_hand(text, smoothing=1.0):
    names = sorted({l for _, l in TRAIN})
    counts = {l: Counter(w for t, k in TRAIN if k == l for w in t.split()) for l in names}
    vocab = {w for c in counts.values() for w in c}
    out = []
    for l in names:
        s = math.log(sum(k == l for _, k in TRAIN) / len(TRAIN))
        for w in text.lower().split():
            if w in vocab:
                s += math.log((counts[l][w] + smoothing) / (sum(counts[l].values()) + smoothing * len(vocab)))
        out.append(s)
    return out


@pytest.mark.parametrize("max_bytes", [naive_bayes.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("smoothing", [1.0, 0.1])
def test_scores_against_hand_computation(make, max_bytes, smoothing):
    texts = ["extra fee", "Hurry hurry hurry two", "standard fee unknown", "nothing known here", "", "..."]
    model = fitted(make, smoothing=smoothing)
    scored = naive_bayes.class_scores(make([(t, "x") for t in texts]), model, ["id"], max_bytes=max_bytes)
    got = {r["id"]: r["scores"] for r in scored.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(by_hand(t, smoothing), abs=1e-9)


def test_text_without_known_words_gets_the_largest_class(make):
    got = score_plan.predict(make([("zzz", "x"), (" \n", "x")]), fitted(make))
    assert values(got, "id", "prediction", "confidence") == [(0, "cost", 50.0)]
    both = score_plan.predict(make([("zzz", "x"), ("", "x")]), fitted(make), skip_blank=False)
    assert both.count() == 2


def test_prediction_contract(make):
    got = score_plan.predict(make([(t, l) for t, l in TRAIN]), fitted(make)).collect()
    for r in got:
        probs = r["all_probabilities"]
        assert abs(sum(probs.values()) - 100) < 0.05
        assert r["confidence"] == max(probs.values()) == probs[r["prediction"]]
        assert set(probs) == {"cost", "normal", "urgent"}
    assert {r["id"]: r["prediction"] for r in got}[0] == "urgent"


def test_save_and_load(spark, make, tmp_path):
    model, path = fitted(make), str(tmp_path / "deep" / "model")
    models.save_naive_bayes(model, path)
    loaded = models.load_naive_bayes(spark, path)
    assert loaded.classes == model.classes and loaded.log_priors == model.log_priors
    texts = make([(t, l) for t, l in TRAIN])
    pick = lambda m: sorted(values(score_plan.predict(texts, m), "id", "prediction", "confidence"))
    assert pick(loaded) == pick(model)


def test_softmax_argmax_ties_and_extremes(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 0.0, -1.0]), (2, [-5000.0, -5001.0, -9000.0]), (3, [800.0, 801.0, 0.0])], "id int, scores array<double>"
    )
    got = {r["id"]: r for r in scoring.with_prediction(df, Classes(("a", "b", "c"))).collect()}
    assert got[1]["prediction"] == "a"
    assert got[2]["probability"][:2] == pytest.approx([0.7310585786, 0.2689414214])
    assert got[3]["prediction"] == "b" and got[3]["confidence"] == 73.11


def test_top_ranks_and_rendering(spark):
    classes = Classes(("a", "b", "c"))
    df = spark.createDataFrame([(1, [0.4, 0.4, 0.2]), (2, [0.0, 0.374, 0.626])], "id int, probability array<double>")
    p = scoring.probabilities_to_prediction(df, classes)
    top = scoring.top_class(scoring.long_form(p, ["id"], classes))
    assert sorted(values(top, "id", "class_name")) == [(1, "a"), (2, "c")]
    ranks = scoring.rank_classes(p, ["id"], classes)
    assert sorted(values(ranks)) == [
        (1, 1, "a", 40.0), (1, 2, "b", 40.0), (1, 3, "c", 20.0), (2, 1, "c", 62.6), (2, 2, "b", 37.4), (2, 3, "a", 0.0),
    ]
    lines = scoring.render(p.where("id = 2"), "id", classes, [("c", "the third")]).orderBy("line_no")
    assert [l for (l,) in values(lines, "line")] == [
        "Category   : c",
        "Confidence : 62.60%",
        "the third",
        "c               " + "█" * 12 + "░" * 8 + "  62.60%",
        "b               " + "█" * 7 + "░" * 13 + "  37.40%",
        "a               " + "░" * 20 + "   0.00%",
    ]


def test_python_hook_loads_once_per_task(make):
    def load():
        calls = []

        def score(batch):
            calls.append(1)
            return batch[["id"]].assign(n=len(calls))

        return score

    got = scoring.score_in_python(make(TRAIN).select("id", "text").coalesce(1), load, "id bigint, n int")
    assert {n for _, n in values(got)} == {1}


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "label string, prediction string")


def test_metrics_with_a_class_never_predicted_and_one_only_predicted(spark):
    df = pairs_of(spark, [("a", "a"), ("a", "a"), ("b", "a"), ("a", "c")])
    got = {r["class"]: r for r in evaluate.per_class(df).collect()}
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"]) == (0.0, 0.0, 0.0)
    assert (got["c"]["support"], got["c"]["recall"], got["c"]["precision"]) == (0, 0.0, 0.0)
    assert got["a"]["precision"] == got["a"]["recall"] == pytest.approx(2 / 3)
    m = evaluate.metrics(df).first()
    assert m["accuracy"] == 0.5 and m["f1_macro"] == pytest.approx(2 / 9)
    report = {r["class"]: r for r in evaluate.report(df).collect()}
    assert report["weighted avg"]["recall"] == 0.5 and report["weighted avg"]["support"] == 4
    assert report["accuracy"]["f1"] == 0.5 and report["accuracy"]["precision"] is None
    assert report["macro avg"]["precision"] == 0.2222
    cells = {(r[0], r[1]): r[2] for r in evaluate.confusion(df).collect()}
    assert len(cells) == 9 and cells["a", "a"] == 2 and cells["c", "c"] == 0 and cells["b", "a"] == 1
    wide = evaluate.confusion_wide(df, ["a", "b", "c"]).orderBy("true_label")
    assert values(wide) == [("a", 2, 0, 1), ("b", 1, 0, 0), ("c", 0, 0, 0)]


def test_error_report(spark):
    wrong = spark.createDataFrame(
        [
            (1, "x" * 130, "a", "b", 99.94, {"a": 0.06, "b": 99.94}),
            (2, "y", "a", "a", 80.0, {"a": 80.0}),
            (3, "z", "b", "a", 99.99, {"b": 0.01}),
        ],
        "id int, text string, label string, prediction string, confidence double, all_probabilities map<string,double>",
    )
    got = values(evaluate.error_report(evaluate.misclassified(evaluate.with_shown_text(wrong))))
    assert got == [(3, "z", "b", "a", 100.0, 0.0), (1, "x" * 120 + "...", "a", "b", 99.9, 0.1)]


def runs_of(spark, series, run="r"):
    rows = [(run, i, "f1_macro", v) for i, v in enumerate(series, start=1)]
    return spark.createDataFrame(rows, "run_id string, candidate int, metric string, value double")


@pytest.mark.parametrize(
    "series, stop, best",
    [
        ([0.5, 0.7, 0.69, 0.8, 0.8, 0.79, 0.9], 6, 4),
        ([0.1, 0.2, 0.3], None, 3),
        ([0.5, 0.5, 0.5], 3, 1),
        ([0.5, 0.4, 0.6, 0.5, 0.7], None, 5),
    ],
)
def test_early_stop(spark, series, stop, best):
    assert values(selection.early_stop(runs_of(spark, series)), "stop", "best") == [(stop, best)]


def test_best_candidate_takes_the_earlier_of_equals(spark):
    runs = runs_of(spark, [0.5, 0.9, 0.9]).union(runs_of(spark, [0.3, 0.2], "q"))
    assert sorted(values(selection.best_candidate(runs))) == [("q", 1, 0.3), ("r", 2, 0.9)]


def test_requests(spark):
    raw = ['{"text":"hi"}', '{"txt":"hi"}', '{"text":5}', '{"text":null}', "broken", '{"text":""}', "[1]", None]
    df = requests.with_request_text(spark.createDataFrame([(r,) for r in raw], "value string"))
    assert sorted(values(requests.accepted(df), "text")) == [("",), ("hi",)]
    assert requests.rejected(df).count() == 6


def language_samples(make):
    de = "der die das und nicht ist ein eine haus".split()
    en = "the and of not is a house with for".split()
    rows = []
    for i in range(120):
        pool, label = (de, "de") if i % 3 == 0 else (en, "en")
        rows.append((" ".join(pool[(i * 7 + j * 3) % 9] for j in range(i % 5 + 3)) + f" n{i}", label))
    return make(rows)


def test_only_rare_words_leave_their_text(spark, make, monkeypatch):
    """A model too large to broadcast: its likeliest words are, and only the others are shuffled."""
    docs = make([("a " * 50 + f"b x{i} y{i}", "pq"[i % 2]) for i in range(40)] + [("", "p"), ("zz zz", "q")])
    p = training.prepare(docs)
    model = p.fit_naive_bayes()
    head, tail = naive_bayes.likeliest(model, model.bytes // 2)
    assert {"a", "b"} <= {t for t, _ in values(head)} and head.count() + tail.count() == model.tokens.count()
    written = []
    monkeypatch.setattr(naive_bayes, "materialize", lambda df, name: written.append((name, materialize(df))) or written[-1][1])
    got = naive_bayes.class_scores(docs, model, ["id"], max_bytes=model.bytes // 2, row="id")
    whole = naive_bayes.class_scores(docs, model, ["id"], row="id")
    assert [name for name, _ in written] == ["other-words"]
    assert {"a", "b"}.isdisjoint({t for t, in values(written[0][1], "token")})
    for (i, s), (j, t) in zip(sorted(values(got)), sorted(values(whole)), strict=True):
        assert i == j and s == pytest.approx(t)


def test_words_are_summed_without_sorting(make):
    """A label beside the id rides on the sums of a text: with it, the words themselves could only be summed by sorting all of them."""
    docs = make([(f"a b x{i} y{i}", "pq"[i % 2]) for i in range(40)])
    p = training.prepare(docs)
    model = p.fit_naive_bayes()
    for limit in (model.bytes, model.bytes // 2):
        scored = naive_bayes.class_scores(p.fold("test"), model, ["id", "label"], max_bytes=limit, row="id")
        plan = scored._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("HashAggregate" in line and "sum(" in line for line in plan)
        assert not [line for line in plan if "SortAggregate" in line and ("sum(" in line or "token" in line)]


def test_stream_equals_batch(spark, make, tmp_path):
    docs = language_samples(make)
    p = training.prepare(docs)
    model = naive_bayes.fit(p.fold("train"), p.classes)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    blank = make([("  ", "x")]).withColumn("id", F.lit(-1).cast("bigint"))
    docs.select("id", "text").union(blank.select("id", "text")).repartition(3).write.parquet(inbox)
    stream = spark.readStream.schema("id bigint, text string").option("maxFilesPerTrigger", 1).parquet(inbox)
    streams.score_stream(stream, model, out, str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.schema("id bigint, prediction string, confidence double").json(out)
    batch = score_plan.predict(docs, model)
    pick = ("id", "prediction", "confidence")
    assert sorted(values(streamed, *pick)) == sorted(values(batch, *pick))


def test_logistic_learns_saves_and_answers_a_stream(spark, make, tmp_path):
    p = training.prepare(language_samples(make))
    model = logistic.fit(p.fold("train"), features=1 << 10)
    scored = score_plan.predict_logistic(p.fold("test"), model, p.classes)
    assert evaluate.metrics(scored).first()["accuracy"] > 0.9
    path = str(tmp_path / "lr")
    model.write().overwrite().save(path)
    models.save_classes(spark, p.classes, path)
    from pyspark.ml import PipelineModel

    loaded, classes = PipelineModel.load(path), models.load_classes(spark, path)
    again = score_plan.predict_logistic(p.fold("test"), loaded, classes)
    pick = ("id", "prediction", "confidence")
    assert sorted(values(again, *pick)) == sorted(values(scored, *pick))

    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    good = p.fold("test").select(F.to_json(F.struct("text")).alias("value"))
    bad = spark.createDataFrame([('{"txt":"hi"}',), ("no json",), ('{"text":"  "}',)], "value string")
    good.union(bad).write.text(inbox)
    q = streams.answer_stream(spark.readStream.text(inbox), loaded, classes, out, str(tmp_path / "cp"))
    q.awaitTermination()
    answers = spark.read.text(out).select(F.from_json("value", "prediction string, confidence double").alias("a"))
    blank = score_plan.predict_logistic(spark.createDataFrame([("  ",)], "text string"), loaded, classes)
    wanted = values(scored, "prediction", "confidence") + values(blank, "prediction", "confidence")
    assert sorted(values(answers, "a.prediction", "a.confidence")) == sorted(wanted)
    refused = str(tmp_path / "refused")
    streams.reject_stream(spark.readStream.text(inbox), refused, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(values(spark.read.text(refused))) == [("no json",), ('{"txt":"hi"}',)]


def test_model_selection(make):
    p = training.with_validation(training.prepare(language_samples(make)))
    folds = {r["fold"]: r["count"] for r in p.corpus.groupBy("fold").count().collect()}
    assert folds == {"train": 76, "valid": 20, "test": 24}
    nb = training.search_naive_bayes(p, [0.5, 1.0])
    assert nb.count() == 8
    lr = training.search_logistic(p, iterations=[1, 2, 3, 4], features=1 << 10)
    best = selection.early_stop(lr).first()
    assert best["best_value"] > 0.5 and lr.select("candidate").distinct().count() <= 4


def test_macro_f1_serves_spark_tuning(make):
    df = language_samples(make)
    train = labels.encode(df, labels.fit_classes(df))
    pipe = logistic.pipeline(features=1 << 10)
    grid = ParamGridBuilder().addGrid(pipe.getStages()[-1].regParam, [0.01, 100.0]).build()
    tuned = TrainValidationSplit(
        estimator=pipe, estimatorParamMaps=grid, evaluator=logistic.MacroF1(), trainRatio=0.75, seed=42
    ).fit(train)
    assert tuned.validationMetrics[0] > tuned.validationMetrics[1]


@pytest.mark.parametrize("max_sums", [64, 6, 1])
def test_search_scores_several_smoothings_in_one_pass(make, monkeypatch, max_sums):
    """Their runs are those of each smoothing alone; the texts are split once for as many as go together."""
    monkeypatch.setattr(training, "MAX_SUMS", max_sums, raising=False)
    p = training.with_validation(training.prepare(make([(f"{t} {i}", l) for i in range(8) for t, l in TRAIN])))
    want = {}
    for i, smoothing in enumerate((0.5, 1.0, 50.0), start=1):
        alone = evaluate.metrics(training.nb_predictions(p.fold("valid"), p.fit_naive_bayes(smoothing))).first().asDict()
        want |= {(i, name): pytest.approx(value) for name, value in alone.items()}
    calls, split = [], naive_bayes.word_rows
    monkeypatch.setattr(naive_bayes, "word_rows", lambda *a, **k: calls.append(a) or split(*a, **k))
    runs = training.search_naive_bayes(p, (0.5, 1.0, 50.0)).collect()
    assert {(r["candidate"], r["metric"]): r["value"] for r in runs} == want
    assert len(calls) == 1 + {64: 1, 6: 2, 1: 3}[max_sums]


def test_texts_are_split_once_for_weights_and_vectors(spark, make):
    df = make(TRAIN)
    train = labels.encode(df, labels.fit_classes(df))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    model, vectors = logistic.fit_terms(train.withColumn("text", read.asNondeterministic()("text")), features=1 << 8)
    got = sorted(map(tuple, vectors.collect()), key=str)
    assert seen.value == len(TRAIN)
    plain = logistic.terms(features=1 << 8).fit(train)
    assert got == sorted(map(tuple, plain.transform(train).select("class_id", "_features").collect()), key=str)
    assert sorted(map(tuple, model.transform(train).select("class_id", "_features").collect()), key=str) == got
