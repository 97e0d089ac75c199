"""Concatenate and cut: all documents end to end, cut into windows of a fixed number of tokens.

Pass one turns each document into token ids and writes them with the task's number and the
running total inside the task. The totals of the tasks, one row each, give every task's global
offset by a prefix sum in two levels. Pass two adds the offsets and cuts at multiples of the
window; a document across a boundary gives one record per window. No row is shuffled, and only
the last window can be short.

Cases: a null or empty text is its end token alone; an empty table gives an empty result;
repeated rows are packed each; other columns are not read. Order is the order of the scan,
fixed by the written table, so a lost task is cut again at the same places.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.arrays import chunks, range_hashes, select_text, text_bytes, word_bounds
from labelmill.llm.token_counts import byte_letters
from labelmill.llm.word_cache import WordCache
from labelmill.scratch import materialize

WINDOW = 2048
END_ID = 1
#: Tasks whose totals are summed together on the first level of the prefix sum.
TASKS_A_BLOCK = 1024

IDS_SCHEMA = "doc_id long, task long, task_start long, doc_tokens long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)



def as_bytes(ids: list[list[int]]) -> list[bytes]:
    raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    ends = (4 * np.cumsum([len(i) for i in ids])).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


#: Distinct words a worker keeps; beyond it starts anew.
ENTRIES = 400_000
#: Signs that are a pre-token of their own after letters.
SIGNS = frozenset(".,;:!?")
#: Below this character, a word of letters is NFC already and its lower case is the plain one.
LATIN_END = "\u0180"


class WordIds:
    """Ids of white-space separated words by a ``tokenizers`` file, as little-endian uint32 bytes.

    The file's pre-tokens never reach across white space, so a text's ids are those of its
    words in turn, and each distinct word is worked out about once. Words are told by a 64-bit hash
    and looked up in a sorted array, all those of a piece of a batch at once; their ids lie in one pool. Latin letters, alone or with
    one sign after them, are lower-cased here and go to the library's model as the one or two
    pre-tokens they are; any other word goes through the library's whole pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.forget()
        self.letters_cache = WordCache(self.encode_letters, 150_000)

    def encode_letters(self, runs: list[str]) -> list[bytes]:
        spell, tokenize = dict(enumerate(self.letters)), self.model.tokenize
        spelt = [r if r.isascii() else r.encode().decode("latin-1").translate(spell) for r in runs]
        return as_bytes([[t.id for t in tokenize(s)] for s in spelt])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        simple, whole = {}, []
        for raw in words:
            word = raw.decode()
            low = word.lower()
            if not low.isalpha() and low[-1] in SIGNS:
                low, sign = low[:-1], low[-1]
            else:
                sign = ""
            if low.isalpha() and (word.isascii() or max(word) < LATIN_END):
                simple[raw] = low, sign
            else:
                whole.append(raw)
        self.letters_cache.fill({*SIGNS, *(low for low, _ in simple.values())})
        ids = self.letters_cache
        found = {raw: ids[low] + ids[sign] if sign else ids[low] for raw, (low, sign) in simple.items()}
        rest = self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)
        found.update(zip(whole, as_bytes([e.ids for e in rest])))
        return [found[w] for w in words]

    def known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word; words that have none yet are worked out first."""
        keys, one, back = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > ENTRIES:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        missing = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if missing.any():
            raw = data.tobytes()
            places = zip(starts[one[missing]].tolist(), ends[one[missing]].tolist())
            self.add(keys[missing], self.encode_words([raw[a:b] for a, b in places]))
            at = np.searchsorted(self.keys, keys)
        return self.entry[at][back]

    def forget(self) -> None:
        """No words, and one entry for the end token."""
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.first, self.sizes = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        entry = np.arange(len(self.sizes), len(self.sizes) + len(ids))
        self.first = np.append(self.first, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        order = np.argsort(np.append(self.keys, keys), kind="stable")
        self.keys, self.entry = np.append(self.keys, keys)[order], np.append(self.entry, entry)[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each with ``end_id`` at its end, their numbers of ids)."""
        starts, ends, first = word_bounds(data, offsets)
        entries = np.insert(self.known(data, starts, ends), first[1:], 0)
        self.pool[0] = end_id
        sizes = self.sizes[entries]
        after = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[entries] - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)]
        per_text = np.add.reduceat(sizes, first[:-1] + np.arange(len(first) - 1)) if len(first) > 1 else np.zeros(0, np.int64)
        return ids, per_text


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document with ``end_id`` at its end, as uint32 bytes, and its place in its task."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, start, encoder = TaskContext.get().partitionId(), 0, word_ids(path)
        for part in chunks(batches):
            ids, sizes = encoder.encode(*text_bytes(part.column("text")), end_id)
            ends = start + np.cumsum(sizes)
            bounds = np.append(0, 4 * np.cumsum(sizes)).astype(np.int32)
            raw = pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "task": pa.array(np.full(len(sizes), task, np.int64)),
                    "task_start": pa.array(ends - sizes),
                    "doc_tokens": pa.array(sizes),
                    "ids": raw,
                }
            )
            start = int(ends[-1])

    return select_text(docs, id_col, text_col).mapInArrow(encode, IDS_SCHEMA)


def task_offsets(ids: DataFrame) -> DataFrame:
    """(task, base): tokens in all tasks before, by sums inside blocks of tasks and sums of the blocks."""
    totals = ids.groupBy("task").agg(F.max(F.col("task_start") + F.col("doc_tokens")).alias("total"))
    totals = totals.withColumn("block", F.floor(F.col("task") / TASKS_A_BLOCK))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = totals.withColumn(
        "inside", F.coalesce(F.sum("total").over(before.partitionBy("block").orderBy("task")), F.lit(0))
    )
    blocks = (
        totals.groupBy("block")
        .agg(F.sum("total").alias("total"))
        .select("block", F.coalesce(F.sum("total").over(before.orderBy("block")), F.lit(0)).alias("outside"))
    )
    return within.join(blocks, "block").select("task", (F.col("inside") + F.col("outside")).alias("base"))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose binary ``column`` holds about ``limit`` bytes, at least one row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)), np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def cut(ids: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document in a window; ``ids`` is a written table of :func:`tokenize`."""

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "ids"):
            begin = np.asarray(part.column("begin"), np.int64)
            n = np.asarray(part.column("doc_tokens"), np.int64)
            pieces = (begin + n - 1) // window - begin // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // window + nth
            lo = np.maximum(begin[row], sequence * window)
            hi = np.minimum(begin[row] + n[row], (sequence + 1) * window)
            start = lo - begin[row]
            raw = part.column("ids")
            views = [memoryview(raw[i].as_buffer()) for i in range(len(raw))]
            crc = [
                zlib.crc32(views[r][4 * s : 4 * e]) for r, s, e in zip(row.tolist(), start.tolist(), (start + hi - lo).tolist())
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "start": pa.array(start),
                    "length": pa.array(hi - lo),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(n[row]),
                    "sequence_id": pa.array(sequence),
                    "offset": pa.array(lo - sequence * window),
                }
            )

    # one row per task of pass one: their number is bounded by the scan's partitions
    placed = ids.join(F.broadcast(task_offsets(ids)), "task")
    return placed.select("doc_id", (F.col("base") + F.col("task_start")).alias("begin"), "doc_tokens", "ids").mapInArrow(
        cut_batches, PIECE_SCHEMA
    )


def pack(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    ids = materialize(tokenize(docs, path, end_id, id_col, text_col), "packing_ids")
    return cut(ids, window)
