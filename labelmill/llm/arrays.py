"""Words of whole Arrow batches as flat numpy arrays: the helper that the text operators share.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are handled as UTF-8 bytes: none of the separators
occurs inside a multi-byte character, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once in a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: The same where a task makes many arrays of a piece.
SMALL_CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95, 0xA0761D6478BD642F))


def select_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so other columns cannot clash with its own."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and other tasks share the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(
    batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, max_rows: int = 1 << 14
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds about ``limit`` bytes, at least one row.

    When a task has used up its batches, what they took is given back.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            stop = min(stop, start + max_rows)
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; the offsets start at 0."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - lo


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and the index of each text's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    start[heads] = solid[heads]
    end[tails] = solid[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


#: Values hashed with one table of powers; longer ranges are put together from blocks.
HASH_BLOCK = 1 << 18


@lru_cache(maxsize=None)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, one block of each."""
    out = []
    for base in (int(_BASES[which]), pow(int(_BASES[which]), -1, 1 << 64)):
        steps = np.full(HASH_BLOCK + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of the values, each times the power of its place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def _long_hash(values: np.ndarray, which: int) -> int:
    """The polynomial of one range of any length, block by block."""
    up, _ = _powers(which)
    total, shift = 0, 1
    for lo in range(0, len(values), HASH_BLOCK):
        block = values[lo : lo + HASH_BLOCK]
        total += shift * int(_sums(block, up)[-1])
        shift = shift * int(up[len(block)]) % (1 << 64)
    return total % (1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each range, by differences of prefix sums.

    Ranges with equal content have equal hashes wherever they lie. ``starts`` must ascend;
    the values are read in blocks, so memory follows the block, not the text.
    """
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(which)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + HASH_BLOCK // 2)))
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        far = e > HASH_BLOCK
        near = np.where(far, s, e)
        sums = _sums(values[base : base + int(near.max())], up)
        out[lo:hi] = (sums[near] - sums[s]) * down[s]
        for i in (np.flatnonzero(far) + lo).tolist():
            out[i] = _long_hash(values[starts[i] : ends[i]], which)
        out[lo:hi] += (e - s).astype(np.uint64)
        lo = hi
    return mix(out, which)


def rolling_hashes(values: np.ndarray, width: int, which: int = 2) -> np.ndarray:
    """The polynomial hash of every run of ``width`` values, by start; ``width`` is at most half a block."""
    up, down = _powers(which)
    n, step = len(values) - width + 1, HASH_BLOCK - width + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, n, step):
        m = min(step, n - lo)
        sums = _sums(values[lo : lo + m + width - 1], up)
        out[lo : lo + m] = (sums[width:] - sums[:-width]) * down[:m]
    return out


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, text index) of every run of ``k`` consecutive words within one text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(before, counts) + first[:-1][doc], doc


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set between each two neighbouring offsets."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
