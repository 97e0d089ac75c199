"""Lineage cuts and size-checked joins, the two things every larger flow here leans on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 256 * 1024 * 1024
MAX_HOT_KEYS = 1000

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, one sub-folder per application.

    A temporary folder of this machine stands in only for a local master.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="labelmill-")
        base = _local_dirs[app]
    return f"{base.rstrip('/')}/labelmill/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    Later passes then read only the columns they need, and a lost executor costs a
    re-read instead of the whole upstream plan.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` written once, with a number that tells its rows apart and stays the same in every later pass.

    It is the row's place in the written table, so rows that are equal or share an id stay
    rows of their own through any explode and aggregate.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint")
    key = F.shiftleft(part, 40) + F.col("_metadata.row_index")  # one file a task
    return materialize(df, "rows").withColumn(name, key)


def row_bytes(schema: T.StructType) -> Column:
    """Upper estimate of the bytes one row takes in a broadcast hash table."""
    size = F.lit(64)
    for field in schema:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType):
            size = size + F.greatest(F.size(col), F.lit(0)) * 16 + 24
        else:
            size = size + 16
    return size.cast("bigint")


def table_bytes(df: DataFrame) -> int:
    """Measured size of a (materialized) table, to hold against a broadcast limit."""
    return df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0


def largest(df: DataFrame, measure: Column, share: float) -> tuple[DataFrame, DataFrame]:
    """``df``, written once, in two: about ``share`` of its rows, those of the greatest ``measure``, and the rest.

    The bound is an approximate quantile; rows that equal it are in the rest.
    """
    written = materialize(df.withColumn("_measure", measure), "measured")
    bound = written.agg(F.percentile_approx("_measure", 1.0 - min(1.0, share), 10_000)).first()[0]
    above = F.col("_measure") > F.lit(bound)
    return written.where(above).drop("_measure"), written.where(~above).drop("_measure")


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold more than 1/MAX_HOT_KEYS of the rows; there are fewer than that many.

    One pass with a fixed-size sketch per task. The sketch only places rows: a key it
    misses is joined like any other, so results never depend on it.
    """
    top, n = (
        df.where(F.col(key).isNotNull())
        .agg(F.expr(f"approx_top_k(`{key}`, {MAX_HOT_KEYS}, {MAX_HOT_KEYS * 10})"), F.count("*"))
        .first()
    )
    return [r["item"] for r in top or [] if r["count"] * MAX_HOT_KEYS > n]


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    spread: str,
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``facts`` with ``dim`` (unique on ``on``), whatever the size and skew.

    A dimension measured below ``max_bytes`` is broadcast, a larger one is shuffled.
    """
    if table_bytes(dim) <= max_bytes:
        return facts.join(F.broadcast(dim), on, how)
    return shuffled_lookup(facts, dim, on, spread, how)


def shuffled_lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    spread: str,
    how: str = "left",
    hot: list | None = None,
    salts: int = 32,
) -> DataFrame:
    """The join for a dimension of any size, on (key, salt).

    The few hot keys of ``facts`` (looked for unless given) are spread over ``salts``
    partitions by a hash of ``spread``, and only their dimension rows are repeated. Null
    keys, which match nothing, are spread the same way.
    """
    hot = hot_keys(facts, on) if hot is None else hot
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False)) if hot else F.lit(False)
    apart = is_hot | F.col(on).isNull()
    salt = F.when(apart, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    every_salt = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        facts.withColumn("_salt", salt)
        .join(dim.withColumn("_salt", F.explode(every_salt)), [on, "_salt"], how)
        .drop("_salt")
    )
