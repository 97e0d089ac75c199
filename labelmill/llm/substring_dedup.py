"""Repeated passages found by phrase automata, and removed from all but their first document.

A window is 50 consecutive words. A word goes when a window that covers it also starts in a
document with a smaller id; windows are judged on the input.

* Anchors. The 25-word phrases of a window are hashed; the rightmost smallest is its anchor. Equal
  windows have equal anchors, so a window can only recur where its anchor does, and about one
  phrase in thirteen is an anchor. One aggregate by anchor confirms the recurring ones.
* Owners. The windows of one anchor in one place form a stretch. If every place of the anchor has
  the same stretch, its smallest id owns all of it. Where stretches differ (at the ends of
  passages and at edits) the windows themselves are aggregated for their smallest ids.
* Automata. Documents are dealt into buckets by their place in the table, so repeated rows do not meet in one; each bucket gets the owners it needs, compiles its
  confirmed phrases into one Aho-Corasick automaton over words, and streams its documents
  through it. Each occurrence takes the verdict of its owner.

Confirmed anchors are told to the scan by a bit map of at most ``MAX_BITS`` bits; a wrong hit
costs work and changes nothing, since owners come from exact joins.

Cases: a null or empty text has no words; documents of fewer than 50 words lose nothing; a null
id counts as larger than every other; rows with one id never take words from each other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import (
    SMALL_CHUNK,
    chunks,
    gram_starts,
    range_hashes,
    release_memory,
    select_text,
    text_bytes,
    word_bounds,
)
from labelmill.llm.skew import free_name, with_row_id
from labelmill.scratch import materialize

WINDOW = 50
PHRASE = 25
#: Text in one bucket, on average.
BUCKET_BYTES = 4 << 20
MAX_BITS = 1 << 27
BITS_A_KEY = 64
BLOCK_BITS = 1 << 16
LAST_ID = (1 << 63) - 1


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor word, phrase hash, first window, last window, text) of every stretch."""
    at, _ = gram_starts(first, PHRASE)
    grams = np.full(len(words), np.uint64(2**64 - 1))
    grams[at] = range_hashes(words, at, at + PHRASE)
    value, index = grams, np.arange(len(words))

    def later(step: int) -> tuple[np.ndarray, np.ndarray]:
        if step >= len(value):
            return value, index
        right = np.concatenate((value[step:], value[-1:].repeat(step)))
        where = np.concatenate((index[step:], index[-1:].repeat(step)))
        take = right <= value
        return np.where(take, right, value), np.where(take, where, index)

    width, span = 1, WINDOW - PHRASE + 1
    while width < span:
        step = min(width, span - width)
        value, index = later(step)
        width += step
    window, doc = gram_starts(first, WINDOW)
    anchor = index[window]
    heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
    tails = np.append(heads[1:], len(anchor))[: len(heads)] - 1
    return anchor[heads], grams[anchor[heads]], window[heads], window[tails], doc[heads]


def words_of(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """(data, starts, ends, first, word hashes) of the column ``text``."""
    column = part.column("text")
    data, offsets = text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    starts, ends, first = word_bounds(data, offsets)
    return data, starts, ends, first, range_hashes(data, starts, ends)


def stretches(rows: DataFrame) -> DataFrame:
    """(phrase, stretch, doc): each anchor with a hash of the words its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SMALL_CHUNK):
            *_, first, words = words_of(part)
            _, phrase, lo, hi, doc = anchors(words, first)
            stretch = range_hashes(words, lo, hi + WINDOW, 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "phrase": pa.array(phrase.view(np.int64)),
                    "stretch": pa.array(stretch.view(np.int64)),
                    "doc": part.column("doc").take(pa.array(doc)),
                }
            )

    return rows.select("doc", "text").mapInArrow(run, "phrase long, stretch long, doc long")


def confirmed(found: DataFrame) -> DataFrame:
    """(phrase, owner, alike) of the phrases in two or more documents; ``alike``: one stretch only."""
    grouped = found.groupBy("phrase").agg(
        F.min("doc").alias("owner"), F.max("doc").alias("other"), (F.min("stretch") == F.max("stretch")).alias("alike")
    )
    return grouped.where("owner < other").drop("other")


def bit_map(keys: DataFrame) -> np.ndarray:
    """Bits set for the ``phrase`` hashes, as bytes; their number is bounded by ``MAX_BITS``."""
    bits = BLOCK_BITS
    wanted = BITS_A_KEY * keys.count()
    while bits < min(wanted, MAX_BITS):
        bits *= 2
    place = keys.select(F.pmod("phrase", F.lit(bits)).alias("place")).distinct()
    place = place.select((F.col("place") / BLOCK_BITS).cast("int").alias("block"), (F.col("place") % BLOCK_BITS).cast("int").alias("bit"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK_BITS, bool)
        block[np.asarray(table.column("bit"))] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(block).tobytes()])})

    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in place.groupBy("block").applyInArrow(pack, "block int, bits binary").collect():  # MAX_BITS bits at most
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = np.mod(hashes.view(np.int64), len(bits) * 8)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def occurrences(rows: DataFrame, recurring: np.ndarray, unlike: np.ndarray) -> DataFrame:
    """Where confirmed phrases may be: (bucket, phrase, w1 null), and windows (bucket, doc, w1, w2) of unlike ones."""
    shared = rows.sparkSession.sparkContext.broadcast((recurring, unlike))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("bucket", "doc", "phrase", "w1", "w2")])
        for part in chunks(batches, SMALL_CHUNK):
            all_, some = shared.value
            *_, first, words = words_of(part)
            _, phrase, lo, hi, doc = anchors(words, first)
            hit = is_set(all_, phrase)
            phrase, lo, hi, doc = phrase[hit], lo[hit], hi[hit], doc[hit]
            bucket, ids = (np.asarray(part.column(c)) for c in ("bucket", "doc"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[doc]), pa.array(ids[doc]), pa.array(phrase.view(np.int64)), *[pa.nulls(len(doc), pa.int64())] * 2],
                schema=schema,
            )
            more = is_set(some, phrase)
            windows, owner = spread(lo[more], hi[more])
            w1, w2 = (range_hashes(words, windows, windows + WINDOW, k) for k in (0, 1))
            doc = doc[more][owner]
            none = pa.nulls(len(doc), pa.int64())
            hashes = [pa.array(w.view(np.int64)) for w in (w1, w2)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[doc]), pa.array(ids[doc]), none, *hashes], schema=schema)

    return rows.select("bucket", "doc", "text").mapInArrow(run, "bucket long, doc long, phrase long, w1 long, w2 long")


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi, and the range each is from."""
    n = hi - lo + 1
    owner = np.repeat(np.arange(len(n)), n)
    return lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def owners(where: DataFrame, phrases: DataFrame) -> DataFrame:
    """(bucket, key, w2, owner) for every bucket: of like phrases (``w2`` null) and of repeated windows."""
    places = where.where("w1 IS NULL").groupBy("bucket", "phrase").agg(F.max("doc").alias("last"))
    like = places.join(phrases, "phrase").select(
        "bucket",
        "phrase",
        F.lit(None).cast("long").alias("w1"),
        F.lit(None).cast("long").alias("w2"),
        F.when(F.col("alike"), F.col("owner")).alias("owner"),
    )
    windows = where.where("w1 IS NOT NULL").groupBy("bucket", "w1", "w2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    repeated = windows.groupBy("w1", "w2").agg(F.min("low").alias("owner"), F.max("high").alias("other")).where("owner < other")
    mine = windows.join(repeated.drop("other"), ["w1", "w2"]).where("high > owner")
    return like.unionByName(mine.select("bucket", F.lit(None).cast("long").alias("phrase"), "w1", "w2", "owner"))


def removed_words(part: pa.Table, known: pa.Table, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the words to remove in one bucket, by an automaton of its confirmed phrases."""
    gone = np.zeros(len(words) + 1, np.int64)
    anchor, phrase, lo, hi, doc = anchors(words, first)
    ids = np.asarray(part.column("doc"))
    columns = {n: known.column(n).combine_chunks() for n in ("phrase", "w1", "w2", "owner")}
    is_phrase = np.asarray(columns["w1"].is_null())
    keys = np.asarray(columns["phrase"].fill_null(0))[is_phrase].view(np.uint64)
    owner = np.asarray(columns["owner"].fill_null(-1))
    alike = np.asarray(columns["owner"].is_valid())
    order = np.argsort(keys)
    keys, phrase_owner, phrase_alike = keys[order], owner[is_phrase][order], alike[is_phrase][order]
    at = np.minimum(np.searchsorted(keys, phrase), max(len(keys) - 1, 0))
    mine = np.flatnonzero(keys[at] == phrase) if len(keys) else np.zeros(0, np.int64)
    if not len(mine):
        return gone[:-1] > 0

    # one automaton over word numbers; a phrase is read off where it first stands in the bucket
    _, numbers = np.unique(words, return_inverse=True)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    _, once = np.unique(phrase[mine], return_index=True)
    for i in mine[once].tolist():
        automaton.add_word(tuple(numbers[anchor[i] : anchor[i] + PHRASE].tolist()), int(at[i]))
    automaton.make_automaton()
    stretch_at = dict(zip(anchor.tolist(), range(len(anchor))))
    hits = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WINDOW:
            for end, which in automaton.iter(tuple(numbers[a:b].tolist())):
                i = stretch_at.get(a + end - PHRASE + 1)
                if i is not None:
                    hits.append((i, which))
    place, which = np.array(hits, np.int64).reshape(-1, 2).T

    like = phrase_alike[which] & (phrase_owner[which] < ids[doc[place]])
    np.add.at(gone, lo[place[like]], 1)
    np.add.at(gone, hi[place[like]] + WINDOW, -1)
    unlike = place[~phrase_alike[which]]
    windows, of = spread(lo[unlike], hi[unlike])
    if len(windows) and not is_phrase.all():
        w1, w2 = (np.asarray(columns[n].fill_null(0))[~is_phrase].view(np.uint64) for n in ("w1", "w2"))
        order = np.argsort(w1)
        w1, w2, window_owner = w1[order], w2[order], owner[~is_phrase][order]
        mine1, mine2 = (range_hashes(words, windows, windows + WINDOW, k) for k in (0, 1))
        at = np.minimum(np.searchsorted(w1, mine1), len(w1) - 1)
        hit = (w1[at] == mine1) & (w2[at] == mine2) & (window_owner[at] < ids[doc[unlike[of]]])
        np.add.at(gone, windows[hit], 1)
        np.add.at(gone, windows[hit] + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each document.

    With ``keep`` also its other columns as ``row``, and ``kept_text`` is the text as it was, null or not, where
    nothing is removed; so a text travels once.
    """
    row_col = free_name(docs.columns, "__row_id")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rest = F.struct(F.col(f"`{text_col}`").isNull().alias(text_col), *others) if keep else F.lit(None).cast("boolean")
    rows = select_text(with_row_id(docs, row_col), id_col, text_col, rest.alias("row"), F.col(row_col).alias("place"))
    row_type = rows.schema["row"].dataType
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST_ID)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    phrases = materialize(confirmed(stretches(rows)), "phrases")
    recurring, unlike = bit_map(phrases), bit_map(phrases.where("NOT alike"))
    where = materialize(occurrences(rows, recurring, unlike), "occurrences")
    known = owners(where, phrases)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string").add("row", row_type)

    def clean(part: pa.Table, mine: pa.Table) -> pa.Table:
        data, starts, ends, first, words = words_of(part)
        gone = removed_words(part, mine, words, first) if mine.num_rows else np.zeros(len(words), bool)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
        raw, kept = memoryview(data), []
        for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), removed.tolist()):
            if keep and not n:
                kept.append(None)
                continue
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([raw[i:j] for i, j in zip(starts[stay].tolist(), ends[stay].tolist())]))
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        if keep:
            as_was = pc.if_else(pc.struct_field(part.column("row"), [0]), pa.scalar(None, pa.string()), part.column("text"))
            kept = pc.if_else(pa.array(removed > 0), kept, as_was.combine_chunks())
        release_memory()
        return pa.table(
            {
                "doc_id": part.column("doc_id"),
                "n_words": pa.array(np.diff(first)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "kept_text": kept,
                "row": part.column("row"),
            }
        )

    texts = rows.select("bucket", "doc_id", "doc", "text", "row")
    out = texts.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(clean, schema)
    return out if keep else out.drop("row")
