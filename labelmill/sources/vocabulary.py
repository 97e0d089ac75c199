"""A user's vocabulary: text files with one piece a line, the line's number being its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.scratch import materialize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files, from 0, files in the order of their names.

    Files may be read in any number of byte ranges: lines are counted per range, and a range's
    first number is the sum of the counts before it. Nothing is sorted but one row per range.
    LF, CR and CRLF end a line; a blank line has its number.
    """
    rows = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("place"),  # ascends within a range, however ranges are packed
    )
    placed = materialize(rows, "lines")
    ranges = placed.groupBy("file", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("file", "range", "first", before.alias("before"))
    # one row per byte range of a scan
    joined = placed.join(F.broadcast(starts), ["file", "range"])
    return joined.select((F.col("before") + F.col("place") - F.col("first")).alias("line_no"), "line")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, token_id): every line that is not blank, white space around it removed."""
    piece = F.btrim("line", F.lit(" \t\r"))
    return numbered_lines(spark, path).select(piece.alias("piece"), F.col("line_no").cast("int").alias("token_id")).where("piece <> ''")


def write_vocabulary(vocab: DataFrame, path: str, piece: str = "piece", token_id: str = "token_id") -> None:
    """One file a partition, pieces in the order of their ids, blank lines where an id is missing."""
    top = vocab.agg(F.max(token_id)).first()[0]
    ids = vocab.sparkSession.range(0, -1 if top is None else top + 1).select(F.col("id").cast("int").alias(token_id))
    lines = ids.join(vocab.select(token_id, piece), token_id, "left").sort(token_id)
    lines.select(F.coalesce(piece, F.lit("")).alias("value")).write.mode("overwrite").text(path)
