"""Words of texts replaced by their ids, without a row for each word.

The most frequent words, a bounded number of them, are sent to every task and looked up where the text
lies, in Arrow. Only occurrences of the other words, the rare ones, are joined to the rest of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.scratch import BROADCAST_BYTES, largest, lookup_join, materialize, with_row_key

#: Words that are sent to every task, and the bytes of the longest one; they only place the work.
NEAR_WORDS = 1 << 19
NEAR_BYTES = 64
#: Words of texts looked up at once.
SLICE_WORDS = 1 << 20

_IDS = T.ArrayType(T.IntegerType())
_RARELY = -(1 << 62)


def with_word_ids(
    df: DataFrame,
    words: str,
    known: DataFrame,
    often: Column,
    unk_id: int,
    out: str,
    near_words: int = NEAR_WORDS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with ``out``, the ids of all words of array column ``words`` in order, in the place of ``words``.

    ``known(word, ids)`` is a written table, unique on word; ``often`` orders its words, most frequent
    ones greatest. A word that is not in it becomes ``unk_id``; a null array is one without words.
    The rest of the table is broadcast below ``max_bytes``.
    """
    short = F.octet_length("word") <= NEAR_BYTES
    n = known.count()  # told by the footers of the written files
    if n <= near_words:
        near, far = known.where(short), known.where(~short)
    else:
        near, far = largest(known, F.when(short, often).otherwise(_RARELY).cast("bigint"), near_words / n)
    near, far = near.select("word", "ids"), far.select("word", "ids")
    if far.isEmpty():
        return _looked_up(df, words, near, T.StructField(out, _IDS), unk_id)
    parts = _looked_up(df, words, near, T.StructField("_parts", T.ArrayType(_IDS)), None)
    rows = with_row_key(parts)
    rare = rows.where(F.size("_rare") > 0).select("_row", F.posexplode("_rare").alias("pos", "word"))
    found = lookup_join(rare, far, "word", "_row", max_bytes=max_bytes)
    item = F.struct("pos", F.coalesce("ids", F.array(F.lit(unk_id))).alias("ids"))
    gaps = found.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    gaps = materialize(gaps.select("_row", F.col("_items.ids").alias("_gaps")), "rare-ids")
    # an array of arrays takes more than its measured bytes
    joined = lookup_join(rows, gaps, "_row", "_row", max_bytes=BROADCAST_BYTES // 4)
    none = F.array().cast("array<int>")
    ends = F.concat(F.coalesce("_gaps", F.array().cast("array<array<int>>")), F.array(none))
    ids = F.flatten(F.zip_with("_parts", ends, lambda part, gap: F.concat(part, gap)))
    return joined.withColumn(out, ids).drop("_row", "_parts", "_rare", "_gaps")


def _looked_up(df: DataFrame, words: str, near: DataFrame, field: T.StructField, unk_id: int | None) -> DataFrame:
    """``df`` with ids of the words of ``near``; without ``unk_id`` cut at the other words, which are in ``_rare``."""
    table = near.toArrow()
    ids = table.column("ids").combine_chunks()
    sizes = np.append(np.asarray(pc.list_value_length(ids)), 0 if unk_id is None else 1).astype(np.int64)
    values = np.append(np.asarray(ids.flatten()), [] if unk_id is None else [unk_id]).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    sent = df.sparkSession.sparkContext.broadcast((table.column("word").combine_chunks(), sizes, starts, values))
    kept = [f for f in df.schema if f.name != words]
    names = [f.name for f in kept]

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        dictionary, sizes, starts, values = sent.value
        column = batch.column(words)
        begin = np.append(0, np.cumsum(np.asarray(pc.list_value_length(column).fill_null(0)))).astype(np.int64)
        flat = column.flatten()
        if flat.type != dictionary.type:
            dictionary = dictionary.cast(flat.type)
        at = np.asarray(pc.index_in(flat, value_set=dictionary).fill_null(len(dictionary))).astype(np.int64)
        n = sizes[at]
        ends = np.append(0, np.cumsum(n))
        found = values[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        columns = [batch.column(c) for c in names]
        if unk_id is not None:
            lists = pa.ListArray.from_arrays(pa.array(ends[begin], pa.int32()), pa.array(found, pa.int32()))
            return pa.RecordBatch.from_arrays([*columns, lists], [*names, field.name])
        rare = at == len(dictionary)
        before = np.append(0, np.cumsum(rare))
        # a part begins with each text and after each rare word
        cuts = np.concatenate([begin[:-1], np.flatnonzero(rare)])
        part_ends = np.append(ends[np.sort(cuts, kind="stable")], ends[-1])
        parts = pa.ListArray.from_arrays(pa.array(part_ends, pa.int32()), pa.array(found, pa.int32()))
        texts = np.arange(len(begin)) + before[begin]
        others = pa.ListArray.from_arrays(pa.array(before[begin], pa.int32()), flat.filter(pa.array(rare)))
        lists = pa.ListArray.from_arrays(pa.array(texts, pa.int32()), parts)
        return pa.RecordBatch.from_arrays([*columns, lists, others], [*names, field.name, "_rare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.append(0, np.cumsum(np.asarray(pc.list_value_length(batch.column(words)).fill_null(0))))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + SLICE_WORDS, "right")) - 1)
                yield look_up(batch.slice(begin, end - begin))
                begin = end

    rare = [] if unk_id is not None else [T.StructField("_rare", T.ArrayType(T.StringType()))]
    return df.mapInArrow(run, T.StructType([*kept, field, *rare]))
