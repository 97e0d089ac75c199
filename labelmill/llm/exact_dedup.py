"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when the same bytes are left without white space. A snapshot is a folder written
once: its classes of equal texts, and one filter per shard of their digests. A new batch is
grouped by digest on its own; only its distinct digests meet the filters, shard by shard. What
passes joins the snapshot's exact buckets, where the two texts are compared byte by byte; what
does not pass is new for sure. Of equal texts the row with the most code points stays, then the
smallest id, then the first row id; null ids come last.

Cases: a null text counts as empty and equals texts of white space alone; an empty batch or
snapshot gives an empty part; repeated rows are copies of each other, and one of them stays;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import binary_fuse
from labelmill.llm.arrays import chunks, select_text
from labelmill.llm.skew import join_counted, only_ids, with_row_id
from labelmill.scratch import materialize, new_path

#: Digests a filter is built for, and the bound of what one task probes at once.
SHARD_KEYS = 50_000
#: Column with an id per row, made from its place in its file unless the caller has one.
ROW_COL = "__row_id"
WHITE = b" \t\n\x0b\x0c\r"

FILTER_SCHEMA = "shard int, seed int, segment int, segments int, fingerprints binary"


@dataclass
class Snapshot:
    """An immutable set of known texts: ``classes`` and ``filters`` below ``path``."""

    path: str
    shards: int

    def classes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/classes")

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(FILTER_SCHEMA).parquet(f"{self.path}/filters")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int")


def digests(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, n_chars, sha): code points of the text, SHA-256 of it without white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text = part.column("text")
            raw = text.cast(pa.binary()).to_pylist()
            sha = [hashlib.sha256(t.translate(None, WHITE)).digest() for t in raw]
            yield pa.RecordBatch.from_pydict(
                {
                    "row_id": part.column("row_id"),
                    "doc_id": part.column("doc_id"),
                    "n_chars": pc.utf8_length(text).cast(pa.int64()),
                    "sha": pa.array(sha, pa.binary()),
                }
            )

    rows = select_text(docs, id_col, text_col, F.col(row_col).alias("row_id"))
    return rows.mapInArrow(run, "row_id string, doc_id long, n_chars long, sha binary")


def rank() -> Column:
    """Smallest for the row that stays."""
    return F.struct(
        (-F.col("n_chars")).alias("less"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"),
        F.col("row_id").alias("row_id"),
    )


def group(rows: DataFrame) -> DataFrame:
    """(sha, best, n): classes of a batch on its own."""
    return rows.groupBy("sha").agg(F.min(rank()).alias("best"), F.count("*").alias("n"))


def write_snapshot(classes: DataFrame, path: str, shard_keys: int = SHARD_KEYS) -> Snapshot:
    """Write ``classes`` (of :func:`group`) and their filters as a new snapshot."""
    spark = classes.sparkSession
    classes.write.parquet(f"{path}/classes")
    snapshot = Snapshot(path, 1)
    snapshot.shards = max(1, -(-snapshot.classes(spark).count() // shard_keys))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        seed, segment, segments, prints = binary_fuse.build(np.asarray(table.column("key")).view(np.uint64))
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "seed": pa.array([seed], pa.int32()),
                "segment": pa.array([segment], pa.int32()),
                "segments": pa.array([segments], pa.int32()),
                "fingerprints": pa.array([prints], pa.binary()),
            }
        )

    keys = snapshot.classes(spark).select(shard_of(snapshot.shards).alias("shard"), F.xxhash64("sha", F.lit(1)).alias("key"))
    keys.groupBy("shard").applyInArrow(make, FILTER_SCHEMA).write.parquet(f"{path}/filters")
    return snapshot


def screen(classes: DataFrame, snapshot: Snapshot, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The ``classes`` of a new batch whose digest passes the snapshot's filters."""
    spark = classes.sparkSession
    blocks = max(1, -(-classes.count() // (snapshot.shards * shard_keys)))
    new = classes.select(
        "sha",
        shard_of(snapshot.shards).alias("shard"),
        F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64("sha", F.lit(1)).alias("key"),
    )
    filters = snapshot.filters(spark).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def probe(rows: pa.Table, one: pa.Table) -> pa.Table:
        if not rows.num_rows or not one.num_rows:
            return pa.table({"sha": pa.array([], pa.binary())})
        f = one.select(["seed", "segment", "segments", "fingerprints"]).to_pylist()[0]
        hit = binary_fuse.contains(
            np.asarray(rows.column("key")).view(np.uint64), f["seed"], f["segment"], f["segments"], f["fingerprints"]
        )
        return rows.select(["sha"]).filter(pa.array(hit))

    keys = ("shard", "block")
    return new.groupBy(*keys).cogroup(filters.groupBy(*keys)).applyInArrow(probe, "sha binary")


def without_white(text: Column) -> Column:
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def same_bytes(pairs: DataFrame, docs: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """The ``sha`` of ``pairs`` (sha, new_row, old_row) whose two texts are byte for byte the same."""
    sides = pairs.select("sha", F.explode(F.array("new_row", "old_row")).alias(row_col))
    ids = materialize(sides.select(row_col).distinct(), "byte_check_rows")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = only_ids(docs.select(row_col, text.alias("text")), ids, row_col)
    found = found.select(row_col, without_white(F.col("text")).alias("bytes"))
    new = found.select(F.col(row_col).alias("new_row"), F.col("bytes").alias("new_bytes"))
    old = found.select(F.col(row_col).alias("old_row"), F.col("bytes").alias("old_bytes"))
    both = pairs.join(new, "new_row").join(old, "old_row")
    return both.where(F.col("new_bytes") == F.col("old_bytes")).select("sha")


def dedup_batch(
    batch: DataFrame, snapshot: Snapshot, docs: DataFrame, row_col: str, text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(classes of the batch, digests it shares with the snapshot, byte-checked), both written.

    ``batch`` holds :func:`digests`; ``docs`` has the texts of batch and snapshot by ``row_col``.
    """
    spark = batch.sparkSession
    classes = materialize(group(batch), "batch_classes")
    maybe = screen(classes, snapshot)
    pairs = (
        maybe.join(classes, "sha")
        .select("sha", F.col("best.row_id").alias("new_row"))
        .join(snapshot.classes(spark).select("sha", F.col("best.row_id").alias("old_row")), "sha")
    )
    pairs = materialize(pairs, "exact_buckets")
    return classes, materialize(same_bytes(pairs, docs, row_col, text_col), "same_bytes")


def dedup(
    docs: DataFrame, first: Column | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per document: (row_id, doc_id, keep_id, group_size, kept, text_sha256).

    Rows where ``first``, an expression on ``doc_id``, holds (default: by a hash, about half) are
    the snapshot, the others a batch that comes later. ``row_col`` names an id of its own per row.
    """
    spark = docs.sparkSession
    keyed = docs if row_col else with_row_id(docs, ROW_COL)
    row_col = row_col or ROW_COL
    rows = digests(keyed, row_col, id_col, text_col)
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if first is None else first
    rows = materialize(rows.withColumn("late", ~F.coalesce(early, F.lit(False))), "digests")
    snapshot = write_snapshot(group(rows.where(~F.col("late"))), new_path(spark, "snapshot"))
    classes, shared = dedup_batch(rows.where("late"), snapshot, keyed, row_col, text_col)
    old = snapshot.classes(spark).withColumn("late", F.lit(False))
    parts = old.unionByName(classes.withColumn("late", F.lit(True)))
    marked = parts.join(shared.withColumn("shared", F.lit(True)), "sha", "left")
    # classes found in both parts become one; the others stay apart
    side = F.when(F.col("shared"), F.lit(2)).otherwise(F.col("late").cast("int"))
    whole = marked.groupBy("sha", side.alias("side")).agg(
        F.min("best").alias("best"), F.sum("n").alias("n"), F.collect_list(F.struct("late", "n")).alias("parts")
    )
    per_part = materialize(
        whole.select(
            "sha",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row_id").alias("keep_row"),
            F.col("n").alias("group_size"),
            F.explode("parts").alias("part"),
        ).select("sha", "part.late", F.col("part.n").alias("rows_here"), "keep_id", "keep_row", "group_size"),
        "classes",
    )
    joined = join_counted(rows, per_part, ["sha", "late"], "rows_here", F.col("row_id"))
    return joined.select(
        "row_id",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
