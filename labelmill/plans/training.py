"""Prepare, train, evaluate and choose."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators import (
    curate,
    evaluate,
    labels,
    logistic,
    naive_bayes,
    sampling,
    scoring,
    selection,
    softmax,
)
from labelmill.operators.labels import Classes
from labelmill.operators.naive_bayes import NaiveBayesModel
from labelmill.scratch import materialize, new_path
from labelmill.sources.models import append_run, read_runs

#: Sums a text has in one pass of a search, over classes and candidates.
MAX_SUMS = 64


@dataclass(frozen=True)
class Prepared:
    """Distinct, encoded corpus with its folds: (id, text, label, class_id, fold)."""

    corpus: DataFrame
    classes: Classes
    train_sizes: dict[str, int]

    def fold(self, name: str) -> DataFrame:
        return self.corpus.where(self.corpus["fold"] == name)

    def fit_naive_bayes(self, smoothing: float = 1.0) -> NaiveBayesModel:
        return naive_bayes.fit(self.fold("train"), self.classes, smoothing=smoothing, sizes=self.sizes_by_id())

    def sizes_by_id(self) -> dict[int, int]:
        """Training texts per class id."""
        return {i: self.train_sizes[name] for i, name in enumerate(self.classes.names)}


def prepare(samples: DataFrame, test_percent: int = 20, seed: int = 42) -> Prepared:
    """Clean, de-duplicate (smallest ``ord`` first), encode and split ``samples(id, ord, text, label)``."""
    narrow = curate.clean(samples.select("id", "ord", "text", "label"))
    distinct = materialize(curate.dedup_keep_first(narrow, priority=["ord"]).drop("ord"), "distinct")
    sizes = labels.class_sizes(distinct)
    classes, quotas = Classes(tuple(sizes)), sampling.split_quotas(sizes, test_percent)
    split = sampling.stratified_split(labels.encode(distinct, classes), seed=seed, quotas=quotas)
    return Prepared(split, classes, quotas)


def with_validation(prepared: Prepared, valid_percent: int = 20, seed: int = 43) -> Prepared:
    """Move part of the train fold to a 'valid' fold, so that choosing never looks at 'test'."""
    quotas = sampling.split_quotas(prepared.train_sizes, valid_percent)
    train = sampling.stratified_split(prepared.fold("train").drop("fold"), seed=seed, quotas=quotas)
    train = train.replace({"test": "valid"}, subset=["fold"])
    return Prepared(train.unionByName(prepared.fold("test")), prepared.classes, quotas)


def nb_predictions(test: DataFrame, model: NaiveBayesModel, keep=("id", "label")) -> DataFrame:
    """Predictions of a fold, whose ids are unique (the split needs that)."""
    return scoring.with_prediction(naive_bayes.class_scores(test, model, list(keep), row="id"), model.classes)


def train_and_test(samples: DataFrame) -> tuple[NaiveBayesModel, DataFrame]:
    """Fit naive Bayes on the train fold, predict the test fold."""
    p = prepare(samples)
    model = p.fit_naive_bayes()
    return model, nb_predictions(p.fold("test"), model)


def _log(test: DataFrame, path: str, run_id: str, candidate: int) -> None:
    append_run(test.sparkSession, path, run_id, candidate, evaluate.metrics(test).first().asDict())


def search_naive_bayes(prepared: Prepared, smoothings: Iterable[float], run_id: str = "nb") -> DataFrame:
    """Run log of one candidate per smoothing, measured on 'valid'.

    Words are counted once, and the texts of 'valid' meet the models of several smoothings in one pass.
    """
    train, valid = prepared.fold("train"), prepared.fold("valid")
    k, smoothings = len(prepared.classes), list(smoothings)
    counts = materialize(naive_bayes.token_class_counts(train, k), "token-counts")
    sizes = prepared.sizes_by_id()
    path = new_path(train.sparkSession, "runs")
    together = max(1, MAX_SUMS // k)
    for first in range(0, len(smoothings), together):
        some = smoothings[first : first + together]
        model = naive_bayes.fit_from_counts(counts, sizes, prepared.classes, some)
        scored = materialize(naive_bayes.class_scores(valid, model, ["id", "label"], row="id"), "scored")
        for i in range(len(some)):
            own = scored.withColumn("scores", F.slice("scores", i * k + 1, k))
            _log(scoring.with_prediction(own, prepared.classes), path, run_id, first + i + 1)
    return read_runs(train.sparkSession, path)


def search_epochs(
    prepared: Prepared,
    epochs: int = softmax.EPOCHS,
    schedule: softmax.Schedule = softmax.Schedule(),
    patience: int = 2,
    run_id: str = "epochs",
) -> tuple[DataFrame, DataFrame]:
    """(run log, weights of the best epoch): softmax regression, each epoch going on from the one before.

    After each epoch the weights are measured on 'valid' and logged; ``early_stop`` reads the log and ends the training.
    """
    spark, k = prepared.corpus.sparkSession, len(prepared.classes)
    path = new_path(spark, "runs")
    rows = softmax.encode(materialize(softmax.word_weights(prepared.fold("train"), ["id", "class_id"]), "words"))
    truth = prepared.fold("valid").withColumnRenamed("class_id", "truth")
    valid = softmax.encode(softmax.word_weights(truth, ["id", "truth"]), rows)  # numbers: names would be summed by sorting
    label = F.element_at(prepared.classes.array(), F.col("truth") + 1)
    weights, by_epoch = None, {}
    for epoch in range(1, epochs + 1):
        weights = by_epoch[epoch] = softmax.run_epoch(rows, weights, k, epoch, schedule)
        scored = scoring.with_prediction(softmax.logits(valid, weights, k, ["id", "truth"]), prepared.classes)
        _log(scored.withColumn("label", label), path, run_id, epoch)
        stopped = selection.early_stop(read_runs(spark, path), patience=patience).first()
        if stopped["stop"] is not None:
            break
        by_epoch = {e: w for e, w in by_epoch.items() if e in (epoch, stopped["best"])}
    return read_runs(spark, path), by_epoch[stopped["best"]].table(rows)


def search_logistic(
    prepared: Prepared, iterations: Iterable[int] = range(1, logistic.ITERATIONS + 1),
    patience: int = 2, run_id: str = "lr", l2: float = logistic.L2, **knobs,
) -> DataFrame:
    """Run log of growing iteration counts on 'valid', stopped early as ``early_stop`` says.

    Texts become term vectors once; ``knobs`` go to ``logistic.terms``.
    """
    train, valid = prepared.fold("train"), prepared.fold("valid")
    spark, path = train.sparkSession, new_path(train.sparkSession, "runs")
    terms, train = logistic.fit_terms(train, **knobs)
    valid = materialize(terms.transform(valid).drop("_words", "_tf"), "valid-terms")
    for n in iterations:
        model = logistic.regression(n, l2).fit(train)
        scored = scoring.probabilities_to_prediction(logistic.probabilities(valid, model), prepared.classes)
        _log(scored, path, run_id, n)
        if selection.early_stop(read_runs(spark, path), patience=patience).first()["stop"] is not None:
            break
    return read_runs(spark, path)
