"""From class scores to predictions, in every shape a caller may want."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.scores import argmax, named_percentages, percent, ranked, with_softmax
from labelmill.functions.text import class_line
from labelmill.operators.labels import Classes, describe


def with_prediction(scored: DataFrame, classes: Classes) -> DataFrame:
    """Add class_id, prediction, confidence and all_probabilities (percent, 2 decimals)."""
    return probabilities_to_prediction(with_softmax(scored, "scores", "probability"), classes)


def probabilities_to_prediction(df: DataFrame, classes: Classes) -> DataFrame:
    """The same from an array column ``probability``."""
    best = df.withColumn("class_id", argmax(F.col("probability")))
    return (
        best.withColumn("prediction", F.element_at(classes.array(), F.col("class_id") + 1))
        .withColumn("confidence", percent(F.array_max("probability")))
        .withColumn("all_probabilities", named_percentages(classes.array(), F.col("probability")))
    )


def short(predicted: DataFrame, keep: Sequence[str]) -> DataFrame:
    return predicted.select(*keep, "prediction", "confidence")


def long_form(predicted: DataFrame, keep: Sequence[str], classes: Classes) -> DataFrame:
    """(*keep, class_id, class_name, p): one row per text and class."""
    return predicted.select(
        *keep, F.posexplode("probability").alias("class_id", "p")
    ).withColumn("class_name", F.element_at(classes.array(), F.col("class_id") + 1))


def top_class(long: DataFrame, id: str = "id") -> DataFrame:
    """Arg-max row per text of a long table; the lowest class id wins a tie.

    An aggregate: each task keeps one row per text, so the classes of a text are not shuffled.
    """
    rest = [c for c in long.columns if c != id]
    best = F.max_by(F.struct(*rest), F.struct("p", -F.col("class_id"))).alias("_best")
    return long.groupBy(id).agg(best).select(*[c if c == id else F.col(f"_best.{c}") for c in long.columns])


def rank_classes(predicted: DataFrame, keep: Sequence[str], classes: Classes) -> DataFrame:
    """(*keep, rank, class_name, pct): all classes of a text, likeliest first. No shuffle."""
    return predicted.select(
        *keep, F.posexplode(ranked(classes.array(), F.col("probability"))).alias("pos", "r")
    ).select(*keep, (F.col("pos") + 1).alias("rank"), F.col("r.class_name"), F.col("r.pct"))


def render(
    predicted: DataFrame, id: str, classes: Classes, descriptions: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """(id, line_no, line): category, confidence, description if any, then a bar per class."""
    described = describe(predicted, descriptions, "prediction") if descriptions else predicted.withColumn(
        "description", F.lit(None).cast("string")
    )
    bars = F.transform(
        ranked(classes.array(), F.col("probability")), lambda r: class_line(r["class_name"], r["pct"])
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("Category   : "), F.col("prediction")),
            F.format_string("Confidence : %.2f%%", "confidence"),
        ),
        F.array_compact(F.array("description")),
        bars,
    )
    return described.select(id, F.posexplode(lines).alias("line_no", "line"))


def score_in_python(df: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """Hook for a model of the user's own, e.g. an exported network.

    ``load()`` runs once per task and returns a function from a pandas batch to a pandas
    batch of ``schema``.
    """

    def run(batches: Iterator) -> Iterator:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)
