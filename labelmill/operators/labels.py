"""Class names and class ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Every scored row carries one probability per class, so the class list is small by nature.
# A column with more distinct values is taken for a wrong column, not cut.
MAX_CLASSES = 10_000


@dataclass(frozen=True)
class Classes:
    """Sorted class names; the position is the class id."""

    names: tuple[str, ...]

    def __len__(self) -> int:
        return len(self.names)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names)), "class_id int, class_name string")

    def array(self) -> Column:
        return F.lit(list(self.names))


def class_sizes(df: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows per non-null label, on the driver. At most MAX_CLASSES entries, checked."""
    rows = (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .count()
        .limit(MAX_CLASSES + 1)
        .collect()
    )
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {label} has more than {MAX_CLASSES} distinct values")
    return {r[0]: r[1] for r in sorted(rows)}


def fit_classes(df: DataFrame, label: str = "label") -> Classes:
    return Classes(tuple(class_sizes(df, label)))


def encode(df: DataFrame, classes: Classes, label: str = "label") -> DataFrame:
    """Add ``class_id``. A label that was not fitted fails the job, as does a null one."""
    ids = F.broadcast(classes.table(df.sparkSession).withColumnRenamed("class_name", label))
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label), F.lit("null"))))
    return df.join(ids, label, "left").withColumn("class_id", F.coalesce("class_id", unseen.cast("int")))


def decode(df: DataFrame, classes: Classes, class_id: str = "class_id") -> DataFrame:
    """Add ``class_name``."""
    names = F.broadcast(classes.table(df.sparkSession).withColumnRenamed("class_id", class_id))
    return df.join(names, class_id, "left")


def describe(df: DataFrame, descriptions: Sequence[tuple[str, str]], label: str = "label") -> DataFrame:
    """Add ``description``, null for a label without one."""
    table = df.sparkSession.createDataFrame(list(descriptions), f"{label} string, description string")
    return df.join(F.broadcast(table), label, "left")
