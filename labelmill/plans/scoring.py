"""Score tables and requests with a fitted model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from labelmill.operators import logistic, naive_bayes, scoring
from labelmill.operators.curate import drop_blank
from labelmill.operators.labels import Classes
from labelmill.operators.naive_bayes import NaiveBayesModel
from labelmill.sources import requests


def predict(df: DataFrame, model: NaiveBayesModel, keep=("id",), skip_blank: bool = True) -> DataFrame:
    """(*keep, prediction, confidence, all_probabilities) per text."""
    texts = drop_blank(df) if skip_blank else df
    scored = scoring.with_prediction(naive_bayes.class_scores(texts, model, list(keep)), model.classes)
    return scored.select(*keep, "prediction", "confidence", "all_probabilities")


def predict_logistic(df: DataFrame, model: PipelineModel, classes: Classes) -> DataFrame:
    """The same columns next to those of ``df``; row-wise, so it serves batches and streams."""
    scored = scoring.probabilities_to_prediction(logistic.probabilities(df, model), classes)
    return scored.drop("probability", "class_id")


def answer_logistic(request_rows: DataFrame, model: PipelineModel, classes: Classes) -> DataFrame:
    """JSON requests in column ``value`` to JSON responses; bad requests give none, blank texts are scored."""
    texts = requests.accepted(requests.with_request_text(request_rows))
    return predict_logistic(texts, model, classes).select(requests.short_response().alias("value"))
