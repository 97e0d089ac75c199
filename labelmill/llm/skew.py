"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.scratch import materialize

#: A key with more than this share of the rows is hot; so there are fewer than HOT_SHARES of them.
HOT_SHARES = 1000


def free_name(columns: list[str], stem: str) -> str:
    while stem in columns:
        stem = f"{stem}_{uuid.uuid4().hex[:6]}"
    return stem


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells rows apart and stays the same in every run.

    It is the row's file and place there; a table without files behind it is written first.
    """
    place = F.concat_ws(":", F.hex(F.xxhash64(F.col("_metadata.file_path"))), F.col("_metadata.row_index"))
    try:
        if "_metadata" not in docs.columns:
            return docs.withColumn(name, place)
    except Exception as e:  # the only test for the hidden column is to ask for it
        if "UNRESOLVED" not in str(e):
            raise
    return materialize(docs.toDF(*docs.columns), "rows").withColumn(name, place)


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row for each of ``keys``; ``count``: its rows).

    Rows of hot keys are dealt by ``spread`` over as many salts as their share asks for, and
    the few lines of ``per_key`` that belong to them are repeated as often.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    limit = max(1, total // HOT_SHARES)
    salts = F.ceil(F.col(count) / limit).cast("int")
    hot = per_key.where(F.col(count) > limit).select(*keys, salts.alias("_salts"))  # fewer than HOT_SHARES rows
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts"))).cast("int")
    )
    repeated = per_key.withColumn(
        "_salt",
        F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))),
    )
    return salted.drop("_salts").join(repeated, [*keys, "_salt"]).drop("_salt")


def without_rows(keyed: DataFrame, dropped: DataFrame, row_col: str, max_rows: int = 1_000_000) -> DataFrame:
    """``keyed`` without the rows named in ``dropped`` (written, column ``row_id``), and without ``row_col``."""
    ids = dropped.select(F.col("row_id").alias(row_col))
    side = F.broadcast(ids) if ids.count() <= max_rows else ids.hint("shuffle_hash")
    return keyed.join(side, row_col, "left_anti").drop(row_col)


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs`` whose ``id_col`` is in ``ids`` (written, one column): sent to all if measured small."""
    n = ids.count()
    side = F.broadcast(ids) if n * 64 <= max_bytes else ids.hint("shuffle_hash")
    return docs.join(side, id_col, "left_semi")
