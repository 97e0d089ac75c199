"""Array expressions over class scores, one array element per class id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_softmax(df: DataFrame, scores: str, out: str) -> DataFrame:
    """Add softmax of the array column ``scores``; shifted by the maximum, so exp() cannot overflow.

    The maximum and the sum are repeated into arrays, which computes each once per row.
    """
    z = F.col(scores)
    shifted = F.zip_with(z, F.array_repeat(F.array_max(z), F.size(z)), lambda x, m: F.exp(x - m))
    e = F.col("_exp")
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return (
        df.withColumn("_exp", shifted)
        .withColumn(out, F.zip_with(e, F.array_repeat(total, F.size(e)), lambda x, s: x / s))
        .drop("_exp")
    )


def argmax(scores: Column) -> Column:
    """Position of the largest element; the lowest class id wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def percent(p: Column) -> Column:
    return F.bround(p * 100, 2)


def named_percentages(names: Column, p: Column) -> Column:
    return F.map_from_arrays(names, F.transform(p, percent))


def ranked(names: Column, p: Column) -> Column:
    """Array of (class_name, pct), largest first; equal percentages keep class order."""
    rows = F.transform(
        p,
        lambda x, i: F.struct(
            (-percent(x)).alias("neg"), i.alias("class_id"), F.element_at(names, i + 1).alias("class_name")
        ),
    )
    return F.transform(
        F.array_sort(rows),
        lambda r: F.struct(r["class_name"].alias("class_name"), (-r["neg"]).alias("pct")),
    )
