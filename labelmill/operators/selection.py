"""Choosing among candidates from a table of their metrics (run_id, candidate, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_candidate(runs: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """(run_id, candidate, value) with the greatest value; the earliest candidate wins a tie."""
    score = F.struct("value", (-F.col("candidate")).alias("early"))
    return (
        runs.where(F.col("metric") == metric)
        .groupBy("run_id")
        .agg(F.max(score).alias("best"))
        .select("run_id", (-F.col("best.early")).alias("candidate"), F.col("best.value").alias("value"))
    )


def early_stop(runs: DataFrame, metric: str = "f1_macro", patience: int = 2) -> DataFrame:
    """(run_id, stop, best, best_value): where training stops, and the best candidate by then.

    It stops at the first candidate that ends ``patience`` evaluations in a row without
    strict improvement over the best before them; ``stop`` is null if that never happens.
    """
    order = W.partitionBy("run_id").orderBy("candidate")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    best_before = F.max("value").over(earlier)
    improved = (best_before.isNull() | (F.col("value") > best_before)).cast("int")
    marked = (
        runs.where(F.col("metric") == metric)
        .withColumn("improved", improved)
        .withColumn("streak", F.sum("improved").over(so_far))
        .withColumn(
            "bad", F.sum(1 - F.col("improved")).over(W.partitionBy("run_id", "streak").orderBy("candidate"))
        )
        .withColumn("stops", F.when(F.col("bad") >= patience, F.col("candidate")))
        .withColumn("stop", F.min("stops").over(W.partitionBy("run_id")))
    )
    seen = F.col("stop").isNull() | (F.col("candidate") <= F.col("stop"))
    score = F.when(seen, F.struct("value", (-F.col("candidate")).alias("early")))
    return (
        marked.groupBy("run_id")
        .agg(F.first("stop").alias("stop"), F.max(score).alias("b"))
        .select("run_id", "stop", (-F.col("b.early")).alias("best"), F.col("b.value").alias("best_value"))
    )
