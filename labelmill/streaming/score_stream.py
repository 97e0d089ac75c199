"""Scoring of unbounded input with a loaded model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmill.operators.labels import Classes
from labelmill.operators.naive_bayes import NaiveBayesModel
from labelmill.plans.scoring import answer_logistic, predict
from labelmill.scratch import with_row_key
from labelmill.sources.requests import accepted, rejected, with_request_key, with_request_text


def answer_stream(
    requests: DataFrame, model: PipelineModel, classes: Classes, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """JSON request lines to JSON response lines. Stateless, exactly once through the file sink."""
    return (
        answer_logistic(requests, model, classes)
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(out)
    )


def reject_stream(requests: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The request lines ``answer_stream`` does not answer because they are not valid."""
    return (
        rejected(with_request_text(requests))
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(out)
    )


def answer_requests(
    requests: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """JSON request lines to keyed answers (``out/answers``) and rejects (``out/rejects``), each exactly once.

    The inbox is read once: a micro-batch is written down with a key for each request (its own
    ``key`` field, else its batch and place in it), and both outputs are made from that table into folders
    named by the batch, which a replay overwrites. ``scorer`` takes (key, text) and returns key,
    prediction and confidence, by whichever model; blank texts are answered.
    """

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        rows = with_request_key(with_request_text(batch.select("value")))
        only_rejects = F.when(F.col("text").isNull(), F.col("value"))  # the others' text is written, not their line
        rows = with_row_key(rows.withColumn("value", only_rejects), "place")
        own = F.concat_ws(":", F.lit(f"batch {batch_id}"), F.col("place"))
        rows = rows.withColumn("key", F.coalesce("key", own))
        answers = scorer(accepted(rows).select("key", "text")).select("key", "prediction", "confidence")
        answers.write.mode("overwrite").json(f"{out}/answers/batch={batch_id}")
        rejected(rows).select("key", "value").write.mode("overwrite").json(f"{out}/rejects/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(answer_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def score_stream(
    texts: DataFrame,
    model: NaiveBayesModel,
    out: str,
    checkpoint: str,
    keep: Sequence[str] = ("id",),
    **trigger,
) -> StreamingQuery:
    """Texts to prediction rows (JSON files) with the naive Bayes scorer.

    Each micro-batch is scored as a table and written to a folder of its own by overwrite,
    so a batch that is replayed after a failure replaces its first try. Rows that share an id
    are scored apart.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        predict(batch, model, keep).write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return (
        texts.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
