import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import softmax
from labelmill.plans import training
from labelmill.scratch import materialize
from tests.conftest import values

TEXTS = ["good cheap good", "bad", "", "good bad price price", "cheap price", None, "bad bad cheap", "new price"]
LABELS = [0, 1, 2, 0, 2, 1, 1, 2]


def plain(texts, labels, batches_by_epoch, schedule, k=3):
    """The same steps with dense arrays."""
    docs = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    names = ["", *sorted({w for d in docs for w in d})]
    x = np.zeros((len(docs), len(names)))
    for i, d in enumerate(docs):
        x[i, 0] = 1
        for w in d:
            x[i, names.index(w)] += 1 / math.sqrt(len(d))
    y = np.eye(k)[labels]
    w, done, out = np.zeros((len(names), k)), 0, []
    for batches in batches_by_epoch:
        for b in range(schedule.batches):
            done += 1
            mine = [i for i, n in enumerate(batches) if n == b]
            if mine:
                z = x[mine] @ w
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                rate = schedule.rate_at(done)
                w = w * (1 - rate * schedule.l2) - rate / len(mine) * x[mine].T @ (p - y[mine])
        out.append(dict(zip(names, w)))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_epochs_equal_dense_gradient_steps(spark, batches):
    schedule = softmax.Schedule(rate=0.7, l2=0.05, warm_up=3, batches=batches)
    df = spark.createDataFrame(list(zip(range(8), TEXTS, LABELS)), "id long, text string, class_id int").repartition(3)
    rows = materialize(softmax.word_weights(df, ["id", "class_id"]))
    dealt = []
    for epoch in (1, 2):
        by_id = dict(values(df.select("id", softmax.batch_of("id", epoch, schedule).alias("b"))))
        dealt.append([by_id[i] for i in range(8)])
    weights = None
    for epoch, want in zip((1, 2), plain(TEXTS, LABELS, dealt, schedule)):
        weights = softmax.run_epoch(rows, weights, 3, epoch, schedule)
        got = dict(values(weights, "token", "w"))
        for token, w in want.items():
            assert np.allclose(got.get(token, np.zeros(3)), w, atol=1e-12), (epoch, token)
    broadcast = softmax.logits(rows, weights, 3, ["id"])
    shuffled = softmax.logits(rows, weights, 3, ["id"], max_bytes=0)
    first, second = (dict(values(d, "id", "scores")) for d in (broadcast, shuffled))
    assert first.keys() == second.keys() and all(np.allclose(first[i], second[i]) for i in first)


def test_warm_up_rises_in_a_line():
    schedule = softmax.Schedule(rate=1.0, warm_up=4)
    assert [schedule.rate_at(t) for t in (1, 2, 4, 9)] == [0.25, 0.5, 1.0, 1.0]
    assert softmax.Schedule(rate=1.0, warm_up=0).rate_at(1) == 1.0


def test_search_stops_and_keeps_the_best_epoch(spark, make):
    pairs = [(f"{'good fine' if i % 2 else 'bad poor'} w{i % 7} n{i}", "xy"[i % 2]) for i in range(60)]
    prepared = training.with_validation(training.prepare(make(pairs)))
    runs, weights = training.search_epochs(prepared, epochs=6, schedule=softmax.Schedule(batches=2), patience=2)
    by_epoch = dict(values(runs.where("metric = 'f1_macro'"), "candidate", "value"))
    best, bad, stop = -1.0, 0, None
    for epoch in sorted(by_epoch):
        best, bad = (by_epoch[epoch], 0) if by_epoch[epoch] > best else (best, bad + 1)
        if bad == 2:
            stop = epoch
            break
    assert max(by_epoch) == (stop or 6) and best > 0.9
    w = dict(values(weights, "token", "w"))
    assert np.argmax(w["good"]) != np.argmax(w["bad"])


def test_too_many_classes_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", 1.0)], "id long, token string, x double")
    with pytest.raises(ValueError):
        softmax.logits(rows, None, softmax.MAX_CLASSES + 1, ["id"])


def dense_step(x, labels, w, rate, l2, k=3):
    """One step over rows that may stand for several texts."""
    z = x @ w
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return w * (1 - rate * l2) - rate / len(x) * x.T @ (p - np.eye(k)[labels])


@pytest.mark.parametrize("max_bytes", [softmax.NEAR_BYTES, 4 * 8 * 3, 0])
def test_epochs_are_equal_wherever_the_weights_lie(spark, max_bytes):
    schedule = softmax.Schedule(rate=0.7, l2=0.05, warm_up=3, batches=2)
    df = spark.createDataFrame(list(zip(range(8), TEXTS, LABELS)), "id long, text string, class_id int").repartition(3)
    terms = softmax.encode(materialize(softmax.word_weights(df, ["id", "class_id"])))
    dealt = []
    for epoch in (1, 2):
        by_id = dict(values(df.select("id", softmax.batch_of("id", epoch, schedule).alias("b"))))
        dealt.append([by_id[i] for i in range(8)])
    weights = None
    for epoch, want in zip((1, 2), plain(TEXTS, LABELS, dealt, schedule)):
        weights = softmax.run_epoch(terms, weights, 3, epoch, schedule, max_bytes)
        got = dict(values(weights.table(terms), "token", "w"))
        assert got.keys() == want.keys()
        assert all(np.allclose(got[token], w, atol=1e-12) for token, w in want.items())
    assert (weights.far is None) == (max_bytes == softmax.NEAR_BYTES)
    other = spark.createDataFrame([(1, "good unseen"), (2, None)], "id long, text string")
    scored = softmax.logits(softmax.encode(softmax.word_weights(other, ["id"]), terms), weights, 3, ["id"], max_bytes)
    scores = dict(values(scored))
    assert np.allclose(scores[1], want[""] + want["good"] / math.sqrt(2)) and np.allclose(scores[2], want[""])


@pytest.mark.parametrize("max_bytes", [softmax.NEAR_BYTES, 0])
def test_texts_of_one_id_are_one_and_those_without_id_only_count(spark, max_bytes):
    rows = [(1, "good cheap", 0), (1, "good", 0), (2, "bad", 1), (3, "price bad", 2), (None, "lost", 1), (None, "gone", 1)]
    df = spark.createDataFrame(rows, "id long, text string, class_id int")
    words = materialize(softmax.word_weights(df, ["id", "class_id"]))
    terms = softmax.encode(words)
    s = 1 / math.sqrt(2)
    names = ["", "good", "cheap", "bad", "price"]
    x = np.array([[2, s + 1, s, 0, 0], [1, 0, 0, 1, 0], [1, 0, 0, s, s], [0, 0, 0, 0, 0]])
    want = dense_step(x, [0, 1, 2, 0], np.zeros((5, 3)), 0.7, 0.05)
    schedule = softmax.Schedule(rate=0.7, l2=0.05, warm_up=0, batches=1)
    weights = softmax.run_epoch(terms, None, 3, 1, schedule, max_bytes)
    got = dict(values(weights.table(terms), "token", "w"))
    assert got.keys() == set(names) and np.allclose([got[t] for t in names], want)
    scores = dict(values(softmax.logits(terms, weights, 3, ["id"], max_bytes)))
    assert scores.keys() == {1, 2, 3, None} and np.allclose([scores[i] for i in (1, 2, 3)], (x @ want)[:3])


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, "", 0), (2, None, 1), (3, "!", 1)], "id long, text string, class_id int")
    terms = softmax.encode(materialize(softmax.word_weights(df, ["id", "class_id"])))
    weights = softmax.run_epoch(terms, None, 2, 1, softmax.Schedule(rate=0.6, l2=0.0, warm_up=0, batches=1))
    assert terms.size == 1 and np.allclose(dict(values(weights.table(terms)))[""], [-0.1, 0.1])


def test_steps_of_a_search_write_no_table(spark, make, monkeypatch):
    written = []

    def noted(df, name="table"):
        written.append(name)
        return materialize(df, name)

    monkeypatch.setattr(softmax, "materialize", noted)
    pairs = [(f"{'good fine' if i % 2 else 'bad poor'} w{i % 7} n{i}", "xy"[i % 2]) for i in range(60)]
    prepared = training.with_validation(training.prepare(make(pairs)))
    training.search_epochs(prepared, epochs=2, schedule=softmax.Schedule(batches=3))
    assert written.count("errors") + written.count("weights") == 0  # was two a step
    assert written.count("scores") == 2  # of the texts of 'valid', one an epoch
