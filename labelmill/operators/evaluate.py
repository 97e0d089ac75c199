"""Classification metrics. Everything after ``pair_counts`` works on at most k x k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import cut
from labelmill.operators.labels import fit_classes


def pairs(truth: DataFrame, predicted: DataFrame, id: str = "id") -> DataFrame:
    """Align true and predicted labels that live in two tables, by id."""
    return truth.join(predicted, id, "inner")


def pair_counts(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def _ratio(num: str, den: str):
    return F.when(F.col(den) == 0, F.lit(0.0)).otherwise(F.col(num) / F.col(den))


def per_class(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """(class, tp, predicted, support, precision, recall, f1) over true and predicted classes.

    A zero denominator gives 0.
    """
    n = F.col("n")
    hit = F.when(F.col("y") == F.col("yhat"), n).otherwise(0)
    as_true = F.struct(F.col("y").alias("class"), hit.alias("tp"), F.lit(0).alias("predicted"), n.alias("support"))
    as_predicted = F.struct(
        F.col("yhat").alias("class"), F.lit(0).alias("tp"), n.alias("predicted"), F.lit(0).alias("support")
    )
    return (
        pair_counts(df, y, yhat)
        .select(F.explode(F.array(as_true, as_predicted)).alias("s"))
        .groupBy("s.class")
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "predicted", "support")])
        .withColumn("precision", _ratio("tp", "predicted"))
        .withColumn("recall", _ratio("tp", "support"))
        .withColumn("both", F.col("predicted") + F.col("support"))
        .withColumn("f1", F.lit(2.0) * _ratio("tp", "both"))
        .drop("both")
    )


def metrics(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """One row: accuracy and macro precision, recall and F1."""
    return per_class(df, y, yhat).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def report(df: DataFrame, y: str = "label", yhat: str = "prediction", digits: int = 4) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg (by support).

    Accuracy stands in the f1 column, the other two are null there. ``section`` orders the
    rows: 0 classes, 1 accuracy, 2 macro, 3 weighted. All rows come from one aggregation.
    """
    parts = [
        F.struct(F.lit(0).alias("section"), F.col("class").alias("name"), F.lit(1).alias("w")),
        F.struct(F.lit(2).alias("section"), F.lit("macro avg").alias("name"), F.lit(1).alias("w")),
        F.struct(F.lit(3).alias("section"), F.lit("weighted avg").alias("name"), F.col("support").alias("w")),
        F.struct(F.lit(1).alias("section"), F.lit("accuracy").alias("name"), F.lit(0).alias("w")),
    ]

    def mean(name: str):
        value = F.when(F.sum("w") > 0, F.sum(F.col(name) * F.col("w")) / F.sum("w"))
        return F.bround(value, digits)

    grouped = (
        per_class(df, y, yhat)
        .withColumn("part", F.explode(F.array(*parts)))
        .select("*", "part.section", "part.name", "part.w")
        .groupBy("section", "name")
        .agg(
            mean("precision").alias("precision"),
            mean("recall").alias("recall"),
            mean("f1").alias("f1"),
            F.bround(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
            F.sum("support").alias("support"),
        )
    )
    f1 = F.when(F.col("section") == 1, F.col("accuracy")).otherwise(F.col("f1"))
    return grouped.select("section", F.col("name").alias("class"), "precision", "recall", f1.alias("f1"), "support")


def confusion(
    df: DataFrame, y: str = "label", yhat: str = "prediction", classes: list[str] | None = None
) -> DataFrame:
    """(true_label, predicted_label, n), zero-filled over the union of both label sets."""
    counts = pair_counts(df, y, yhat)
    if classes is None:
        both = df.select(F.explode(F.array(y, yhat)).alias("label"))
        classes = list(fit_classes(both).names)
    cells = df.sparkSession.createDataFrame([(c,) for c in classes], "true_label string").select(
        "true_label", F.explode(F.lit(classes)).alias("predicted_label")
    )
    same = (cells["true_label"] == counts["y"]) & (cells["predicted_label"] == counts["yhat"])
    return cells.join(counts, same, "left").select(
        "true_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_wide(df: DataFrame, classes: list[str], y: str = "label", yhat: str = "prediction") -> DataFrame:
    """One row per true class, one count column per predicted class."""
    return confusion(df, y, yhat, classes).groupBy("true_label").pivot("predicted_label", classes).agg(F.sum("n"))


def with_shown_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``shown``, the display form of the text, to be kept through scoring."""
    return df.withColumn("shown", cut(F.col(text)))


def misclassified(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Rows with a wrong prediction. Needs all_probabilities; texts are not needed yet."""
    return df.where(F.col(y) != F.col(yhat)).withColumn(
        "true_class_prob", F.col("all_probabilities")[F.col(y)]
    )


def error_report(
    wrong: DataFrame, id: str = "id", text: str = "shown", y: str = "label", yhat: str = "prediction"
) -> DataFrame:
    """(id, text, true_label, predicted_label, confidence_pct, true_class_prob), surest first.

    Percentages with one decimal. Add the display text by ``with_shown_text`` and keep it
    through scoring; then no text has to be joined to the errors afterwards.
    """
    return wrong.select(
        id,
        F.col(text).alias("text"),
        F.col(y).alias("true_label"),
        F.col(yhat).alias("predicted_label"),
        F.bround("confidence", 1).alias("confidence_pct"),
        F.bround("true_class_prob", 1).alias("true_class_prob"),
    ).orderBy(F.desc("confidence_pct"), id)
