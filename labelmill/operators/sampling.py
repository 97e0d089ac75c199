"""Exact seeded sampling and splitting by class, without sorting a class.

Rows of a class are ordered by md5(seed:id), id. Taking the first q of them needs only the
q-th row of that order, the class's *cut*. It is found by counting rows per hash bucket
(65,536 per class by default) and ranking the one bucket the cut falls into. Membership is
then a comparison with a table of one row per class: the corpus itself is never shuffled,
and a class with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.operators.labels import class_sizes


def seeded_hash(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def with_rank_within(
    df: DataFrame,
    quotas: dict[str, int],
    out: str,
    label: str = "label",
    id: str = "id",
    seed: int = 42,
    bucket_digits: int = 4,
) -> DataFrame:
    """Add boolean ``out``: is the row among the first ``quotas[label]`` rows of its class?

    ``id`` must be unique. ``df`` is read three times, twice only (label, id); materialize it
    first if it is costly.
    """
    spark = df.sparkSession
    quota_rows = [(k, q) for k, q in quotas.items() if q > 0]
    quota = F.broadcast(spark.createDataFrame(quota_rows, "_label string, quota bigint"))
    keyed = df.select(
        F.col(label).alias("_label"), F.col(id).alias("_id"), seeded_hash(id, seed).alias("_hash")
    ).withColumn("_bucket", F.substring("_hash", 1, bucket_digits))

    by_bucket = keyed.groupBy("_label", "_bucket").agg(F.count("*").alias("n")).join(quota, "_label")
    upto = F.sum("n").over(W.partitionBy("_label").orderBy("_bucket"))
    boundary = (
        by_bucket.withColumn("before", upto - F.col("n"))
        .where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("n") >= F.col("quota")))
        .select("_label", "_bucket", (F.col("quota") - F.col("before")).alias("need"))
    )
    boundary = F.broadcast(spark.createDataFrame(boundary.collect(), boundary.schema))

    rank = F.row_number().over(W.partitionBy("_label").orderBy("_hash", "_id"))
    cuts = (
        keyed.join(boundary, ["_label", "_bucket"])
        .withColumn("rank", rank)
        .where(F.col("rank") == F.col("need"))
        .select(F.col("_label"), F.col("_hash").alias("_cut_hash"), F.col("_id").alias("_cut_id"))
    )
    cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))

    # A class without a cut compares with (null, null), which sorts before every row.
    here = F.struct(seeded_hash(id, seed).alias("h"), F.col(id).alias("i"))
    cut = F.struct(F.col("_cut_hash").alias("h"), F.col("_cut_id").alias("i"))
    return (
        df.join(cuts, df[label] == cuts["_label"], "left")
        .withColumn(out, here <= cut)
        .drop("_label", "_cut_hash", "_cut_id")
    )


def balance(
    df: DataFrame, label: str = "label", id: str = "id", seed: int = 42, bucket_digits: int = 4
) -> DataFrame:
    """As many rows of every class as the smallest class has; rows without a label go."""
    sizes = class_sizes(df, label)
    least = min(sizes.values(), default=0)
    if least == 0:
        return df.limit(0)
    picked = with_rank_within(
        df, dict.fromkeys(sizes, least), "_picked", label, id, seed, bucket_digits
    )
    return picked.where("_picked").drop("_picked")


def split_quotas(sizes: dict[str, int], test_percent: int = 20) -> dict[str, int]:
    """Train rows per class: proportional, largest remainders first, ties by label."""
    total = sum(sizes.values())
    n_test = -(-total * test_percent // 100)
    n_train = total - n_test
    small = [k for k, n in sizes.items() if n < 2]
    if small:
        raise ValueError(f"classes with fewer than 2 rows: {small}")
    if min(n_test, n_train) < len(sizes):
        raise ValueError(f"folds of {n_train} and {n_test} rows cannot hold {len(sizes)} classes")
    quotas = {k: n * n_train // total for k, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda k: (-(sizes[k] * n_train % total), k))
    for k in by_remainder[: n_train - sum(quotas.values())]:
        quotas[k] += 1
    return quotas


def stratified_split(
    df: DataFrame,
    test_percent: int = 20,
    label: str = "label",
    id: str = "id",
    seed: int = 42,
    bucket_digits: int = 4,
    quotas: dict[str, int] | None = None,
) -> DataFrame:
    """Add ``fold`` ('train' or 'test'); both folds keep the class proportions.

    Every row of a known label gets exactly one fold, so the folds are complements.
    ``quotas`` may hand in the train rows per class if they are known already.
    """
    quotas = split_quotas(class_sizes(df, label), test_percent) if quotas is None else quotas
    known = df.where(F.col(label).isNotNull())
    marked = with_rank_within(known, quotas, "_train", label, id, seed, bucket_digits)
    return marked.withColumn(
        "fold", F.when(F.col("_train"), F.lit("train")).otherwise(F.lit("test"))
    ).drop("_train")
