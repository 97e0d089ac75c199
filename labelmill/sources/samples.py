"""Sample tables: reading, tagging, writing.

A sample has ``text``, ``label`` and ``ord``, its place in its source. Spark rows have no
position, so "the earlier row" always means the smaller ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from labelmill import schemas
from labelmill.sources.publish import current, publish

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
MAX_RECORDS_PER_FILE = 1_000_000

# The texts pandas' read_csv takes as missing by default.
PANDAS_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def row_order(minor: Column, major: Column | None = None) -> Column:
    """``ord`` for a table that carries its own row number(s)."""
    return F.struct(
        F.lit("").alias("part"),
        (F.lit(0) if major is None else major).cast("bigint").alias("major"),
        minor.cast("bigint").alias("minor"),
    )


def file_order(place: int = 0) -> Column:
    """``ord`` for a file source: place in the list of paths, file, byte range, row within the range.

    Holds however Spark packs the byte ranges into tasks.
    """
    return F.struct(
        F.concat(F.lit(f"{place:08d}:"), F.col("_metadata.file_path")).alias("part"),
        F.col("_metadata.file_block_start").alias("major"),
        F.monotonically_increasing_id().alias("minor"),
    )


def empty_samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.SAMPLES_IN_ORDER)


def _exists(reader: DataFrameReader, path: str) -> bool:
    try:
        reader.load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark.read.format("text"), current(spark, path))


def read_samples(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    null_tokens: Iterable[str] = (),
    multi_line: bool = True,
    missing_ok: bool = False,
) -> DataFrame:
    """Read (text, label, ord) from CSV, Parquet, ORC or JSON.

    ``null_tokens`` are texts to read as null (``PANDAS_NULLS`` gives pandas' reading).
    ``multi_line`` accepts line breaks inside quotes, at one task per CSV file; turn it off
    to split big files that have none. With ``missing_ok`` absent paths read as empty.
    Rows of an earlier path come first in ``ord``.
    """
    reader = spark.read.schema(schemas.SAMPLES)
    if fmt == "csv":
        reader = reader.options(multiLine=multi_line, **CSV_OPTIONS)
    paths = [current(spark, p) for p in ([path] if isinstance(path, str) else path)]
    reader = reader.format(fmt)
    if missing_ok:
        paths = [p for p in paths if _exists(reader, p)]
        if not paths:
            return empty_samples(spark)
    nulls = list(null_tokens)

    def read_null(name: str) -> Column:
        col = F.col(name)
        return (F.when(~col.isin(nulls), col) if nulls else col).alias(name)

    return reduce(
        DataFrame.unionByName,
        [
            reader.load(p).select(read_null("text"), read_null("label"), file_order(i).alias("ord"))
            for i, p in enumerate(paths)
        ],
    )


def literal_samples(spark: SparkSession, texts: Sequence[str], label: str) -> DataFrame:
    """A short hand-written list, all of one label, in list order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
    return tag_source(rows.select("text", row_order(F.col("pos")).alias("ord")), label)


def tag_source(df: DataFrame, label: str) -> DataFrame:
    """Give every row of a source the same label."""
    return df.withColumn("label", F.lit(label))


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than there are cores; others stay as they are.

    For tables read straight into CPU-heavy text work. A table of many files is untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_samples(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Publish ``df`` as the new content of ``path``; null labels and columns as Spark writes them.

    ``df`` may read ``path`` itself: what was there stays readable until the new rows stand, and
    for good if writing them fails.
    """
    writer = df.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if fmt == "csv":
        writer = writer.options(
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_OPTIONS
        )
    publish(df.sparkSession, path, writer.format(fmt).save)
