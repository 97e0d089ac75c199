"""JSON requests ``{"text": "..."}`` in, JSON responses out; same code for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_request_text(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``text``: the request's text field, or null if the request is not valid.

    Broken JSON, a missing field and a field that is not a string are all not valid.
    """
    parsed = F.try_variant_get(F.try_parse_json(value), "$.text", "variant")
    is_string = F.schema_of_variant(parsed) == "STRING"
    return df.withColumn("text", F.when(is_string, F.try_variant_get(parsed, "$", "string")))


def with_request_key(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``key``: the request's own ``key`` field as text, null if it has none or is no JSON."""
    return df.withColumn("key", F.try_variant_get(F.try_parse_json(value), "$.key", "string"))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("text").isNotNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("text").isNull()).drop("text")


def short_response() -> Column:
    return F.to_json(F.struct("prediction", "confidence"))


def full_response() -> Column:
    return F.to_json(F.struct("prediction", "confidence", "all_probabilities"))
