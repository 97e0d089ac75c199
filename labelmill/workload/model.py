"""Registered queries: training, prediction, evaluation, selection, storage, streams."""

from __future__ import annotations

from contextlib import suppress
from dataclasses import replace

from pyspark.sql import functions as F

from labelmill.functions.scores import argmax, percent, with_softmax
from labelmill.operators import evaluate, logistic, scoring, selection
from labelmill.plans import scoring as score_plan
from labelmill.plans import training
from labelmill.scratch import materialize, new_path
from labelmill.sources import models
from labelmill.streaming import score_stream as streams
from labelmill.workload.base import nb_sql, samples, table



def _nb(spark, sf, label="lang"):
    """Fitted model and materialized test predictions, without the texts."""
    p = training.prepare(samples(spark, sf, label))
    model = p.fit_naive_bayes()
    predicted = training.nb_predictions(p.fold("test"), model, ["id", "label"])
    return p, model, materialize(predicted, "predicted")


def nb_fit(spark, sf):
    p = training.prepare(samples(spark, sf))
    model = p.fit_naive_bayes()
    per_class = model.tokens.select("token", F.posexplode("weights").alias("class_id", "w"))
    return per_class.select("token", "class_id", F.round("w", 6).alias("log_likelihood"))


def nb_predict(spark, sf):
    return _nb(spark, sf)[2].select("id", "label", "class_id", "prediction", "confidence")


def nb_predict_source(spark, sf):
    return _nb(spark, sf, "source")[2].select("id", "label", "class_id", "prediction", "confidence")


def nb_probabilities(spark, sf):
    p, _, predicted = _nb(spark, sf, "source")
    long = scoring.long_form(predicted, ["id"], p.classes)
    return long.select("id", "class_id", "class_name", F.round("p", 6).alias("p"))


def top_class(spark, sf):
    p, _, predicted = _nb(spark, sf, "source")
    top = scoring.top_class(scoring.long_form(predicted, ["id"], p.classes))
    return top.select("id", "class_id", "class_name", F.round("p", 6).alias("p"))


def rank_classes(spark, sf):
    p, _, predicted = _nb(spark, sf, "source")
    return scoring.rank_classes(predicted, ["id"], p.classes)


def class_report(spark, sf):
    return evaluate.report(_nb(spark, sf, "source")[2])


def metrics(spark, sf):
    m = evaluate.metrics(_nb(spark, sf, "source")[2])
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


PER_CLASS = """
pair_counts AS (SELECT label AS y, prediction AS yhat, count(*) AS n FROM best GROUP BY label, prediction),
names AS (SELECT y AS class FROM pair_counts UNION SELECT yhat FROM pair_counts),
per_class AS (
  SELECT class, tp, predicted, support,
         CASE WHEN predicted = 0 THEN 0.0E0 ELSE tp / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0E0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
         2.0E0 * (tp / CAST(predicted + support AS DOUBLE)) AS f1
  FROM (SELECT class,
               CAST((SELECT coalesce(sum(n), 0) FROM pair_counts WHERE y = class AND yhat = class) AS BIGINT) AS tp,
               CAST((SELECT coalesce(sum(n), 0) FROM pair_counts WHERE yhat = class) AS BIGINT) AS predicted,
               CAST((SELECT coalesce(sum(n), 0) FROM pair_counts WHERE y = class) AS BIGINT) AS support
        FROM names))"""


def confusion_matrix(spark, sf):
    return evaluate.confusion(_nb(spark, sf, "source")[2])


def confusion_wide(spark, sf):
    """Languages as true classes, one column each as predicted class."""
    p, _, predicted = _nb(spark, sf)
    return evaluate.confusion_wide(predicted, list(p.classes.names))


def error_report(spark, sf):
    p = training.prepare(samples(spark, sf, "source"))
    model = p.fit_naive_bayes()
    test = evaluate.with_shown_text(p.fold("test"))
    predicted = training.nb_predictions(test, model, ["id", "label", "shown"])
    return evaluate.error_report(evaluate.misclassified(materialize(predicted, "predicted")))


def error_report_csv(spark, sf):
    """The error report written as CSV and read back."""
    path = new_path(spark, "errors")
    models.write_errors(error_report(spark, sf), path)
    return models.read_errors(spark, path)


def embedding_argmax(spark, sf):
    """``embeddings`` as logits: softmax, arg-max and confidence per row."""
    z = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    p = with_softmax(z, "z", "p")
    return p.select("vec_id", argmax(F.col("z")).alias("class_id"), percent(F.array_max("p")).alias("confidence"))


def _event_runs(spark, sf):
    """Mean event value per type and step of 500 events, as a run log."""
    steps = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("run_id"), F.floor(F.col("event_id") / 500).cast("int").alias("candidate")
    )
    return steps.agg(F.round(F.avg("value"), 6).alias("value")).withColumn("metric", F.lit("f1_macro"))


EVENT_RUNS = """
runs AS (
  SELECT event_type AS run_id, CAST(event_id // 500 AS INTEGER) AS candidate, round(avg(value), 6) AS value
  FROM events GROUP BY event_type, event_id // 500)"""


def best_candidate(spark, sf):
    return selection.best_candidate(_event_runs(spark, sf))


def early_stop(spark, sf):
    return selection.early_stop(_event_runs(spark, sf), patience=2)


def run_log(spark, sf):
    """Every candidate logged in two halves, one half logged again as a retry would, and read back."""
    runs = materialize(_event_runs(spark, sf), "event-runs")
    path = new_path(spark, "runs")
    for half in ("candidate % 2 = 0", "candidate % 2 = 1", "candidate % 2 = 0"):
        models.log_runs(runs.where(half), path)
    return models.read_runs(spark, path)


SMOOTHINGS = (0.1, 1.0, 10.0)


def smoothing_search(spark, sf):
    """Naive Bayes smoothings measured on a validation fold."""
    p = training.with_validation(training.prepare(samples(spark, sf, "source")))
    runs = training.search_naive_bayes(p, SMOOTHINGS)
    return runs.select("run_id", "candidate", "metric", F.round("value", 9).alias("value"))


def logistic_search(spark, sf):
    """Logistic regression with growing iteration counts, stopped early."""
    p = training.with_validation(training.prepare(samples(spark, sf)))
    runs = training.search_logistic(p)
    return selection.early_stop(runs)


def epoch_search(spark, sf):
    """Softmax regression trained epoch by epoch, each measured on a validation fold, until it stops getting better."""
    p = training.with_validation(training.prepare(samples(spark, sf)))
    runs, _ = training.search_epochs(p)
    return selection.early_stop(runs)


def nb_roundtrip(spark, sf):
    """Predictions of a model that was saved and loaded."""
    p = training.prepare(samples(spark, sf))
    path = new_path(spark, "model")
    models.save_naive_bayes(p.fit_naive_bayes(), path)
    loaded = models.load_naive_bayes(spark, path)
    return training.nb_predictions(p.fold("test"), loaded).select("id", "label", "prediction", "confidence")


def nb_resave(spark, sf):
    """A model saved over the folder it was loaded from; a save that fails halfway then changes nothing."""
    p = training.prepare(samples(spark, sf))
    path = new_path(spark, "model")
    models.save_naive_bayes(p.fit_naive_bayes(), path)
    loaded = models.load_naive_bayes(spark, path)
    models.save_naive_bayes(loaded, path)
    broken = loaded.tokens.withColumn("token", F.raise_error(F.lit("a failing write")).cast("string"))
    with suppress(Exception):
        models.save_naive_bayes(replace(loaded, tokens=broken), path)
    again = models.load_naive_bayes(spark, path)
    return training.nb_predictions(p.fold("test"), again).select("id", "label", "prediction", "confidence")


def score_repeated_ids(spark, sf):
    """All documents scored under ids that two of them share: each text keeps its own prediction."""
    model = training.prepare(samples(spark, sf)).fit_naive_bayes()
    shared = samples(spark, sf).select(F.floor(F.col("id") / 2).alias("id"), "text")
    return score_plan.predict(shared, model, skip_blank=False).select("id", "prediction", "confidence")


def _lr(spark, sf):
    p = training.prepare(samples(spark, sf))
    return p, logistic.fit(p.fold("train"))


def lr_predict(spark, sf):
    p, model = _lr(spark, sf)
    scored = score_plan.predict_logistic(p.fold("test"), model, p.classes)
    return scored.select("id", "label", "prediction", "confidence")


def model_roundtrip(spark, sf):
    p, model = _lr(spark, sf)
    path = new_path(spark, "pipeline")
    models.save_pipeline(model, p.classes, path)
    loaded, classes = models.load_pipeline(spark, path)
    scored = score_plan.predict_logistic(p.fold("test"), loaded, classes)
    return scored.select("id", "label", "prediction", "confidence")


def stream_score(spark, sf):
    """All documents as a stream, scored by naive Bayes trained on the train fold."""
    p = training.prepare(samples(spark, sf))
    model = p.fit_naive_bayes()
    # a pattern, as a plain path has to be a folder: the table is a file or a folder of files
    documents = spark.readStream.schema("doc_id bigint, text string").parquet(f"{sf}/documents.parque[t]")
    texts = documents.withColumnRenamed("doc_id", "id")
    out = new_path(spark, "stream")
    streams.score_stream(texts, model, out, new_path(spark, "stream-checkpoint")).awaitTermination()
    rows = spark.read.schema("id bigint, prediction string, confidence double, batch int").json(out)
    return rows.select("id", "prediction", "confidence")


def _inbox(spark, sf):
    """Documents as requests with a key, and events, which are JSON without a text."""
    inbox = new_path(spark, "inbox")
    bad = table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_id").alias("key"), "props")).alias("value"))
    good = samples(spark, sf).select(F.to_json(F.struct(F.col("id").cast("string").alias("key"), "text")).alias("value"))
    good.union(bad).write.text(inbox)
    return spark.readStream.text(inbox)


def stream_answers(spark, sf):
    """JSON requests as a text stream, answered by naive Bayes, answers told by key."""
    model = training.prepare(samples(spark, sf)).fit_naive_bayes()
    out = new_path(spark, "outbox")

    def scorer(texts):
        return score_plan.predict(texts, model, ["key"], skip_blank=False)

    streams.answer_requests(_inbox(spark, sf), scorer, out, new_path(spark, "answer-checkpoint")).awaitTermination()
    return spark.read.schema("key string, prediction string, confidence double").json(f"{out}/answers/batch=*")


def stream_rejects(spark, sf):
    """The requests of the same inbox that have no text, as logistic regression leaves them unanswered."""
    p, model = _lr(spark, sf)
    out = new_path(spark, "outbox")

    def scorer(texts):
        return score_plan.predict_logistic(texts, model, p.classes)

    streams.answer_requests(_inbox(spark, sf), scorer, out, new_path(spark, "answer-checkpoint")).awaitTermination()
    rejects = spark.read.schema("key string, value string").json(f"{out}/rejects/batch=*")
    return rejects.select("key", F.get_json_object("value", "$.props").alias("props"))


def python_scorer(spark, sf):
    """The hook for a user's own model, with one that labels a text by its length."""

    def load():
        def score(batch):
            short = batch["text"].str.len() < 1000
            return batch[["id"]].assign(prediction=short.map({True: "short", False: "long"}))

        return score

    docs = samples(spark, sf).select("id", "text")
    return scoring.score_in_python(docs, load, "id bigint, prediction string")


def label_pairs(spark, sf):
    """Truth and prediction kept in two tables, aligned by id: report of toxic against quality."""
    marks = table(spark, sf, "labels")
    truth = marks.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label"))
    guess = marks.select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("prediction"))
    return evaluate.report(evaluate.pairs(truth, guess))


REPORT = """
  SELECT 0 AS section, class, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall,
         round_even(f1, 4) AS f1, support FROM per_class
  UNION ALL
  SELECT 1, 'accuracy', NULL, NULL, round_even(sum(tp) / CAST(sum(support) AS DOUBLE), 4), CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL
  SELECT 2, 'macro avg', round_even(avg(precision), 4), round_even(avg(recall), 4), round_even(avg(f1), 4),
         CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL
  SELECT 3, 'weighted avg', round_even(sum(precision * support) / sum(support), 4),
         round_even(sum(recall * support) / sum(support), 4), round_even(sum(f1 * support) / sum(support), 4),
         CAST(sum(support) AS BIGINT) FROM per_class"""



def _candidate_sql(candidate: int, smoothing: float) -> str:
    return f"""
  SELECT 'nb' AS run_id, {candidate} AS candidate, unnest(['accuracy', 'precision_macro', 'recall_macro', 'f1_macro']) AS metric,
         unnest([round(accuracy, 9), round(precision_macro, 9), round(recall_macro, 9), round(f1_macro, 9)]) AS value
  FROM (WITH {nb_sql('source', smoothing=smoothing, validation=True)}, {PER_CLASS}
        SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(precision) AS precision_macro,
               avg(recall) AS recall_macro, avg(f1) AS f1_macro FROM per_class)"""


SEARCH = " UNION ALL ".join(_candidate_sql(i, x) for i, x in enumerate(SMOOTHINGS, start=1))
ALL_DOCUMENTS = "SELECT doc_id AS id, text, lang AS label FROM documents"
ERRORS = """CASE WHEN length(f.text) > 120 THEN substring(f.text, 1, 120) || '...' ELSE f.text END AS text,
  b.label AS true_label, b.prediction AS predicted_label, round_even(b.confidence, 1) AS confidence_pct,
  round_even(round_even(p.p * 100, 2), 1) AS true_class_prob
  FROM best b JOIN folds f ON f.id = b.id JOIN probs p ON p.id = b.id AND p.class_name = b.label
  WHERE b.label <> b.prediction"""

BEST_LANG = "id, label, class_id, prediction, confidence FROM best"

QUERIES = {
    "nb_fit": (
        nb_fit,
        f"""WITH {nb_sql()} SELECT l.token, q.class_id, round(l.ll, 6) AS log_likelihood
            FROM likelihoods l JOIN quotas q ON q.label = l.label""",
    ),
    "nb_predict": (nb_predict, f"WITH {nb_sql()} SELECT {BEST_LANG}"),
    "nb_predict_source": (nb_predict_source, f"WITH {nb_sql('source')} SELECT {BEST_LANG}"),
    "nb_probabilities": (
        nb_probabilities,
        f"WITH {nb_sql('source')} SELECT id, class_id, class_name, round(p, 6) AS p FROM probs",
    ),
    "top_class": (
        top_class,
        f"""WITH {nb_sql('source')} SELECT b.id, b.class_id, b.prediction AS class_name, round(p.p, 6) AS p
            FROM best b JOIN probs p ON p.id = b.id AND p.class_id = b.class_id""",
    ),
    "rank_classes": (
        rank_classes,
        f"""WITH {nb_sql('source')}
            SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pct DESC, class_id) AS INTEGER) AS rank, class_name, pct
            FROM (SELECT *, round_even(p * 100, 2) AS pct FROM probs)""",
    ),
    "class_report": (class_report, f"WITH {nb_sql('source')}, {PER_CLASS} {REPORT}"),
    "metrics": (
        metrics,
        f"""WITH {nb_sql('source')}, {PER_CLASS}
            SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 9) AS accuracy, round(avg(precision), 9) AS precision_macro,
                   round(avg(recall), 9) AS recall_macro, round(avg(f1), 9) AS f1_macro FROM per_class""",
    ),
    "label_pairs": (
        label_pairs,
        f"""WITH best AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS prediction FROM labels),
            {PER_CLASS} {REPORT}""",
    ),
    "confusion_matrix": (
        confusion_matrix,
        f"""WITH {nb_sql('source')},
            names AS (SELECT label AS name FROM best UNION SELECT prediction FROM best)
            SELECT t.name AS true_label, p.name AS predicted_label, count(b.id) AS n
            FROM names t CROSS JOIN names p LEFT JOIN best b ON b.label = t.name AND b.prediction = p.name
            GROUP BY t.name, p.name""",
    ),
    "confusion_wide": (
        confusion_wide,
        f"""WITH {nb_sql()}
            SELECT label AS true_label, count(*) FILTER (prediction = 'de') AS de, count(*) FILTER (prediction = 'en') AS en,
                   count(*) FILTER (prediction = 'es') AS es, count(*) FILTER (prediction = 'fr') AS fr
            FROM best GROUP BY label""",
    ),
    "error_report": (error_report, f"WITH {nb_sql('source')} SELECT b.id, {ERRORS}"),
    "error_report_csv": (error_report_csv, f"WITH {nb_sql('source')} SELECT {ERRORS}"),
    "embedding_argmax": (
        embedding_argmax,
        """SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS class_id,
                  round_even(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) * 100, 2) AS confidence
           FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings)""",
    ),
    "best_candidate": (
        best_candidate,
        f"""WITH {EVENT_RUNS} SELECT run_id, candidate, value FROM (
              SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, candidate) AS rn FROM runs) WHERE rn = 1""",
    ),
    "early_stop": (
        early_stop,
        f"""WITH {EVENT_RUNS},
            a AS (SELECT *, max(value) OVER (PARTITION BY run_id ORDER BY candidate
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
            b AS (SELECT *, CASE WHEN before IS NULL OR value > before THEN candidate END AS better FROM a),
            c AS (SELECT *, max(better) OVER (PARTITION BY run_id ORDER BY candidate) AS last_better FROM b),
            d AS (SELECT run_id, candidate, value,
                         count(*) FILTER (better IS NULL) OVER (PARTITION BY run_id, last_better ORDER BY candidate) AS bad FROM c),
            e AS (SELECT *, min(CASE WHEN bad >= 2 THEN candidate END) OVER (PARTITION BY run_id) AS stop FROM d),
            f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, candidate) AS rn
                  FROM e WHERE stop IS NULL OR candidate <= stop)
            SELECT run_id, stop, candidate AS best, value AS best_value FROM f WHERE rn = 1""",
    ),
    "run_log": (run_log, f"WITH {EVENT_RUNS} SELECT run_id, candidate, 'f1_macro' AS metric, value FROM runs"),
    "smoothing_search": (smoothing_search, SEARCH),
    "logistic_search": (logistic_search, None),
    "epoch_search": (epoch_search, None),
    "nb_roundtrip": (
        nb_roundtrip, f"WITH {nb_sql()} SELECT id, label, prediction, confidence FROM best",
    ),
    "lr_predict": (lr_predict, None),
    "model_roundtrip": (model_roundtrip, None),
    "stream_score": (
        stream_score,
        f"WITH {nb_sql(scored=ALL_DOCUMENTS)} SELECT id, prediction, confidence FROM best",
    ),
    "nb_resave": (nb_resave, f"WITH {nb_sql()} SELECT id, label, prediction, confidence FROM best"),
    "score_repeated_ids": (
        score_repeated_ids,
        f"WITH {nb_sql(scored=ALL_DOCUMENTS)} SELECT id // 2 AS id, prediction, confidence FROM best",
    ),
    "stream_answers": (
        stream_answers,
        f"""WITH {nb_sql(scored="SELECT doc_id AS id, text, lang AS label FROM documents WHERE text IS NOT NULL")}
            SELECT CAST(id AS VARCHAR) AS key, prediction, confidence FROM best""",
    ),
    "stream_rejects": (stream_rejects, "SELECT CAST(event_id AS VARCHAR) AS key, props FROM events"),
    "python_scorer": (
        python_scorer,
        "SELECT doc_id AS id, CASE WHEN length(text) < 1000 THEN 'short' ELSE 'long' END AS prediction FROM documents",
    ),
}
