"""Corpus curation: union, clean, de-duplicate, correct, count, profile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import not_blank
from labelmill.operators.labels import MAX_CLASSES
from labelmill.operators.tokens import with_dense_ids
from labelmill.scratch import lookup_join, materialize, with_row_key

#: Runs of rows in order that are sent to every task.
MAX_RUNS = 1_000_000
#: Row places (8 bytes each) sent to every task at once.
MAX_PLACES = 8_000_000

# Label descriptions, in class order.
DESCRIPTIONS = (
    ("disguised_ad", "📢 Advertisement disguised as normal content"),
    ("fake_urgency", "⚠️ Creates fake urgency or pressure"),
    ("hidden_cost", "💰 Contains hidden charges or extra fees"),
    ("normal", "✅ Normal transparent content"),
)


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; ``source_rank`` keeps the list order as priority."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def with_positions(united: DataFrame, max_runs: int = MAX_RUNS) -> DataFrame:
    """``united`` with ``position`` 0, 1, 2, ... in the order of (source_rank, ord), texts staying where they lie.

    Only places and order columns are sorted. Rows that lie in that order, as those of a file do, form
    runs whose positions follow from the first one; the runs are sent to the rows. Where the rows are so mixed that
    there are more than ``max_runs`` runs, positions are joined row by row instead.
    """
    keyed = with_row_key(united)
    narrow = keyed.select("_row", "source_rank", "ord")
    placed = materialize(with_dense_ids(narrow, ["source_rank", "ord", "_row"], "position", kind="bigint"), "positions")
    part = F.shiftright("_row", 40).alias("_part")
    runs = placed.groupBy(part, (F.col("position") - F.col("_row")).alias("_shift")).agg(
        F.min("_row").alias("_lo"), F.max("_row").alias("_hi"), F.count("*").alias("_n")
    )
    runs = materialize(runs, "runs")
    whole = runs.agg(F.count("*").alias("n"), F.count_if(F.col("_hi") - F.col("_lo") + 1 != F.col("_n")).alias("mixed")).first()
    if whole["mixed"] or whole["n"] > max_runs:
        return keyed.join(placed.select("_row", "position"), "_row").drop("_row")
    inside = (F.shiftright(keyed["_row"], 40) == runs["_part"]) & keyed["_row"].between(runs["_lo"], runs["_hi"])
    found = keyed.join(F.broadcast(runs), inside)
    return found.select(*united.columns, (F.col("_row") + F.col("_shift")).alias("position"))


def clean(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Drop a row if its text or its label is null."""
    return df.na.drop("any", subset=[text, label])


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop texts that are empty or white space only (and null ones)."""
    return df.where(not_blank(F.col(text)))


def dedup_keep_first(
    df: DataFrame, text: str = "text", priority: Sequence[str] = ("source_rank", "ord")
) -> DataFrame:
    """One row per exact text: the one first in ``priority`` order. Null texts are equal."""
    return dedup_with_counts(df, text, priority)[0]


def dedup_with_counts(
    df: DataFrame, text: str = "text", priority: Sequence[str] = ("source_rank", "ord")
) -> tuple[DataFrame, dict[str, int]]:
    """:func:`dedup_keep_first`, and the rows before, after and removed, without another pass over ``df``.

    The rows are written once. Which of them stay is decided on their SHA-256, priority and place
    alone, by an aggregate that each task begins on its own copies; so no text is sorted or shuffled, and a
    text that makes up a third of the corpus sends one short row per task. The places of the rows
    that go then filter the written table.
    """
    keyed = with_row_key(df)
    digest = F.unhex(F.sha2(F.col(text), 256)).alias("_digest")
    first = keyed.select(digest, F.struct(*priority, "_row").alias("_first")).groupBy("_digest").agg(F.min("_first").alias("_first"))
    places = keyed.select("_row").join(first.select("_first._row"), "_row", "left_anti")
    dropped = materialize(places, "dropped")
    n, removed = keyed.count(), dropped.count()  # told by the footers of the written files
    kept = without_places(keyed, dropped, removed).select(*df.columns)
    return kept, {"rows_before": n, "rows_after": n - removed, "removed": removed}


def without_places(keyed: DataFrame, dropped: DataFrame, n: int, max_rows: int = MAX_PLACES) -> DataFrame:
    """``keyed`` without the rows whose ``_row`` is among the ``n`` of ``dropped`` (both written), where they lie.

    Up to ``max_rows`` places are sent to every task at once. More of them are sent in rounds, each
    with the places of a range of the table's files, and each reading these files only.
    """
    if n <= max_rows:
        return keyed.join(F.broadcast(dropped), "_row", "left_anti")
    part = F.shiftright("_row", 40)
    sizes = dropped.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a file
    rounds, taken = [0], 0
    for row in sizes:
        if taken and taken + row["n"] > max_rows:
            rounds.append(row["part"])
            taken = 0
        taken += row["n"]
    done = []
    for lo, hi in zip(rounds, [*rounds[1:], 1 << 22]):
        files = keyed.where(F.col("_metadata.file_name").between(f"part-{lo:05d}", f"part-{hi - 1:05d}~"))
        mine = dropped.where((part >= lo) & (part < hi))
        done.append(files.join(F.broadcast(mine), "_row", "left_anti"))
    return reduce(DataFrame.unionByName, done)


def duplicates_removed(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows before, rows after and rows lost by de-duplication, as one row.

    Counts SHA-256 digests, so whole texts are read but only 32 bytes each are shuffled.
    """
    digest = F.unhex(F.sha2(F.col(text), 256))
    null_text = F.max(F.col(text).isNull().cast("int"))
    return df.agg(
        F.count("*").alias("rows_before"),
        (F.countDistinct(digest) + F.coalesce(null_text, F.lit(0))).alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def override_labels(df: DataFrame, overrides: DataFrame, spread: str, on: str = "text") -> DataFrame:
    """Replace labels by those of ``overrides(on, label)`` where it has the row.

    Should ``overrides`` name a key twice, its smallest label counts. ``spread`` is the
    column that spreads the rows of a hot key over tasks, such as the row's id; never the key.
    """
    new = materialize(overrides.groupBy(on).agg(F.min("label").alias("_label")), "overrides")
    joined = lookup_join(df, new, on, spread)
    return joined.withColumn("label", F.coalesce("_label", "label")).select(*df.columns)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n), null labels left out."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def min_class_size(df: DataFrame, label: str = "label") -> DataFrame:
    return class_counts(df, label).agg(F.min("n").alias("min_class_size"))


def profile(df: DataFrame, label: str = "label", text: str = "text", ord: str = "ord") -> DataFrame:
    """Per label: number of samples and its first text as the example.

    The first row of each label is chosen by its place; only the chosen texts are fetched.
    """
    keyed = with_row_key(df.select(label, text, ord))
    counted = keyed.groupBy(label).agg(F.count("*").alias("samples"), F.min(F.struct(ord, "_row")).alias("_first"))
    chosen = counted.select(label, "samples", "_first._row")
    if chosen.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"column {label} has more than {MAX_CLASSES} distinct values")
    return keyed.select("_row", F.col(text).alias("example")).join(F.broadcast(chosen), "_row").select(label, "samples", "example")
