"""Removal of every byte that a repeated string of 400 bytes covers, by expanding suffix intervals.

Texts are UTF-8 bytes. A window is 400 consecutive bytes of one document; each byte of a window
that also starts anywhere else goes, first occurrences included. Windows are judged on the input.

* Screen. The smallest hash of the 100-byte grams of a window is its anchor; equal windows have
  equal anchors. Neighbouring windows with one anchor form a stretch. One aggregate by anchor
  leaves the places whose anchor occurs twice, about one row for each 150 bytes of repeated text.
* Shards. A stretch that occurs in many places is sent once, with the number of its places as its
  weight. Stretches are sharded by anchor, so equal windows meet in one shard. The stretches of an
  anchor that fill a shard alone (the edges of a passage that very many documents share) are
  broken into windows; windows are sent once each, and only those with two places or more.
* Intervals. A shard sorts the suffixes of its stretches by prefix doubling and takes their
  Burrows-Wheeler transform. Breadth-first backward extension (Beller, Gog, Ohlebusch, Schnattinger) finds
  the boundaries of common prefixes by increasing value: a boundary of value l, extended by each symbol of
  the interval to its right, gives the boundaries of value l + 1. It stops at the minimum length,
  so what is then still undivided shares 400 bytes, and an interval whose places weigh two or
  more is a repeated window.
* Removal. Each place takes the verdict of its stretch; documents with any are read again and cut.

Cases: a null or empty text has no bytes; texts shorter than 400 bytes lose nothing; very long
texts are screened in blocks; rows with one id, and repeated rows, are documents of their own and so take
windows from each other; a null id is kept; an empty table gives an empty result; other columns
are not read. Stretches are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.arrays import chunks, gram_starts, mix, range_hashes, rolling_hashes, select_text, text_bytes
from labelmill.llm.skew import free_name, join_counted, only_ids, with_row_id
from labelmill.scratch import materialize

MIN_LENGTH = 400
GRAM = 100
#: Window starts screened at once, and text bytes taken from a batch at once.
BLOCK = 1 << 20
SCAN_BYTES = 1 << 18
#: Bytes of stretches in a shard, on average; an anchor with more is broken into windows.
SHARD_BYTES = 1 << 20
PLACE_BITS = np.uint64(21)
KEY = ["anchor", "s1", "s2"]
PLACE = "anchor: long, s1: long, s2: long, lo: int, hi: int"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: block-wise minima from the left and from the right."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, s1, s2) of the stretches of all texts; windows count from the text's start."""
    found = []
    for start in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[start : start + BLOCK + length - 1]
        bounds = np.clip(offsets - start, 0, len(block))
        window, text = gram_starts(bounds, length)
        if not len(window):
            continue
        grams = mix(rolling_hashes(block, gram))
        keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_minimum(keys, length - gram + 1)[window]
        anchor = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        lo, hi = window[heads], window[np.append(heads[1:], len(anchor)) - 1]
        text = text[heads]
        hashes = [range_hashes(block, lo, hi + length, k).view(np.int64) for k in (0, 1)]
        shift = start - offsets[text]
        found.append((text, lo + shift, hi + shift, grams[anchor[heads]].view(np.int64), *hashes))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found))


def scan(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, doc_id, n_bytes, sha256, places): each document with its digest and its stretches."""
    schema = f"row string, doc_id long, n_bytes long, sha256 string, places array<struct<{PLACE}>>"
    place = [("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SCAN_BYTES):
            data, offsets = text_bytes(part.column("text"))
            text, lo, hi, anchor, s1, s2 = stretches(data, offsets, length, gram)
            values = pa.StructArray.from_arrays(
                [pa.array(x, t) for x, (_, t) in zip((anchor, s1, s2, lo, hi), place)], fields=[pa.field(*p) for p in place]
            )
            order = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(order), values),
                ],
                ["row", "doc_id", "n_bytes", "sha256", "places"],
            )

    return rows.select("row", "doc_id", "text").mapInArrow(run, schema)


def sort_suffixes(symbols: np.ndarray, rest: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Suffix array of pieces that each end in symbol 0, by prefix doubling; equal suffixes in the order of their pieces.

    ``rest`` is the number of symbols before the piece's end. Only suffixes not yet told apart are sorted again.
    """
    n = len(symbols)
    used = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    used[symbols] = 1
    used[0] = 0
    letters = np.cumsum(used) * used  # dense numbers, so that more of them fit one key
    bits = max(1, int(letters.max()).bit_length())
    h = 63 // bits
    padded = np.append(letters[symbols], np.zeros(h, np.int64))
    key, live = np.zeros(n, np.int64), np.ones(n, np.int64)
    for t in range(h):
        now = padded[t : n + t] * live
        key = (key << bits) | now
        live = (now > 0).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)
    while len(open_):
        at = order[open_]
        group = rank[at]
        goes_on = rest[at] >= h
        second = np.where(goes_on, rank[np.minimum(at + h, n - 1)] + n, piece[at])
        turn = np.argsort(group * (2 * n) + second)
        at, group, second = at[turn], group[turn], second[turn]
        order[open_] = at
        new = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def interval_widths(flags: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Distance from each of ``heads`` to the next set flag after it; the last flag is set."""
    out = np.ones(len(heads), np.int64)
    open_, start, step = np.flatnonzero(~flags[heads + 1]), 2, 8
    while len(open_):
        if len(open_) * step > len(flags):  # as many looks as flags: look them all up
            bounds = np.flatnonzero(flags)
            out[open_] = bounds[np.searchsorted(bounds, heads[open_], "right")] - heads[open_]
            break
        look = flags[np.minimum(heads[open_, None] + (start + np.arange(step)), len(flags) - 1)]
        at = look.argmax(1)
        hit = look[np.arange(len(open_)), at]
        out[open_[hit]] = start + at[hit]
        open_, start, step = open_[~hit], start + step, step * 8
    return out


def divided(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Flags of the suffixes, in suffix order, that share fewer than ``length`` symbols with the one before.

    Values are found by increasing size, from the transform ``bwt`` and its last-to-first mapping.
    """
    n = len(symbols)
    bwt = np.where(order > 0, symbols[order - 1], 0)
    by_symbol = np.argsort(bwt, kind="stable")
    last_to_first = np.empty(n, np.int64)
    last_to_first[by_symbol] = np.arange(n)
    before = np.full(n, -1, np.int64)  # the previous place of the same symbol
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]

    flags = np.zeros(n + 1, bool)
    flags[n] = True
    counts = np.bincount(symbols)
    flags[: counts[0]] = True  # every end is a symbol of its own
    flags[np.cumsum(counts)[:-1]] = True
    new = np.flatnonzero(flags[:n])
    for _ in range(1, length):
        if not len(new):
            break
        width = interval_widths(flags, new)
        head = np.repeat(new, width)
        place = head + np.arange(len(head)) - np.repeat(np.cumsum(width) - width, width)
        first = (bwt[place] > 0) & (before[place] < head)
        new = last_to_first[place[first]]
        new = np.sort(new[~flags[new]])
        flags[new] = True
    return flags[:n]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Flags of the positions of ``data`` where a string of ``length`` bytes starts that occurs twice or more.

    Piece ``i`` is ``data[offsets[i]:offsets[i + 1]]`` and stands for ``weights[i]`` places.
    """
    pieces = len(weights)
    piece = np.repeat(np.arange(pieces), np.diff(offsets) + 1)
    ends = offsets[1:] + np.arange(pieces)
    symbols = np.zeros(len(piece), np.int16)
    body = np.ones(len(piece), bool)
    body[ends] = False
    symbols[body] = data.astype(np.int16) + 1
    rest = ends[piece] - np.arange(len(piece))
    order = sort_suffixes(symbols, rest, piece)
    interval = np.cumsum(divided(symbols, order, length)) - 1
    long_enough = rest[order] >= length
    places = np.bincount(interval, weights=np.where(long_enough, weights[piece[order]], 0))
    out = np.zeros(len(piece), bool)
    out[order] = long_enough & (places[interval] >= 2)
    return out[body]


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last) of the runs of set flags; a run ends with its piece."""
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    set_ = np.flatnonzero(flags)
    new = np.append(True, (np.diff(set_) > 1) | (piece[set_][1:] != piece[set_][:-1]))[: len(set_)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(set_))[: len(heads)] - 1
    of = piece[set_[heads]]
    return of, set_[heads] - offsets[of], set_[tails] - offsets[of]


def cut_pieces(units: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, s1, s2, weight, piece): the bytes of ``units`` (key, weight, rep: row, lo, hi), cut from their documents."""
    unit = F.struct(*KEY, "weight", F.col("rep.lo").alias("lo"), F.col("rep.hi").alias("hi"))
    wanted = units.groupBy(F.col("rep.row").alias("row")).agg(F.collect_list(unit).alias("units"))  # parts of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1 << 18):
            texts = part.column("text").cast(pa.large_binary())
            n = np.asarray(pc.list_value_length(part.column("units")))
            flat = pc.list_flatten(part.column("units"))
            columns = {c: flat.field(k) for k, c in enumerate((*KEY, "weight"))}
            owner = np.repeat(np.arange(part.num_rows), n)
            lo, hi = (np.asarray(flat.field(k)).tolist() for k in (4, 5))
            views = [memoryview(texts[i].as_buffer()) for i in range(part.num_rows)]
            pieces = [bytes(views[d][a : b + length]) for d, a, b in zip(owner.tolist(), lo, hi)]
            yield pa.RecordBatch.from_pydict(columns | {"piece": pa.array(pieces, pa.binary())})

    schema = "anchor long, s1 long, s2 long, weight long, piece binary"
    return texts.select("row", "text").join(wanted, "row").drop("row").mapInArrow(run, schema)


def verdicts(units: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, s1, s2, runs): the windows of each unit that occur twice or more, as runs of their numbers."""
    total = units.agg(F.sum(F.col("rep.hi") - F.col("rep.lo") + length)).first()[0] or 0
    number = max(1, -(-total // SHARD_BYTES))
    pieces = cut_pieces(units, texts, length).withColumn("shard", F.pmod("anchor", F.lit(number)))

    def judge(table: pa.Table) -> pa.Table:
        column = table.column("piece")
        data, offsets = text_bytes(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        flags = repeated_windows(data, offsets, np.asarray(table.column("weight")), length)
        of, first, last = runs(flags, offsets)
        hit, n = np.unique(of, return_counts=True)
        ends = np.append(0, np.cumsum(n)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(ends), pairs)
        return pa.table({**{c: table.column(c).take(pa.array(hit)) for c in KEY}, "runs": lists})

    schema = "anchor long, s1 long, s2 long, runs array<struct<a:int,b:int>>"
    return pieces.groupBy("shard").applyInArrow(judge, schema)


def broken_verdicts(units: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The same for units whose anchors fill a shard alone: window by window.

    Windows are hashed where they stand; those that weigh two or more are sent, once each.
    """
    unit = F.struct(*KEY, "weight", F.col("rep.lo").alias("lo"), F.col("rep.hi").alias("hi"))
    wanted = units.groupBy(F.col("rep.row").alias("row")).agg(F.collect_list(unit).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1 << 18):
            data, offsets = text_bytes(part.column("text"))
            n = np.asarray(pc.list_value_length(part.column("units")))
            flat = pc.list_flatten(part.column("units"))
            fields = [np.asarray(flat.field(k)) for k in range(6)]
            owner = np.repeat(np.arange(part.num_rows), n)
            order = np.lexsort((fields[4], owner))
            owner, fields = owner[order], [f[order] for f in fields]
            width = (fields[5] - fields[4] + 1).astype(np.int64)
            which = np.repeat(np.arange(len(width)), width)
            off = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
            place = fields[4][which] + off
            start = place + offsets[owner[which]]
            w1, w2 = (range_hashes(data, start, start + length, k).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: pa.array(fields[k][which]) for k, c in enumerate((*KEY, "weight"))},
                    "off": pa.array(off, pa.int32()),
                    "row": part.column("row").take(pa.array(owner[which])),
                    "place": pa.array(place, pa.int32()),
                    "w1": pa.array(w1),
                    "w2": pa.array(w2),
                }
            )

    schema = "anchor long, s1 long, s2 long, weight long, off int, row string, place int, w1 long, w2 long"
    windows = materialize(texts.select("row", "text").join(wanted, "row").mapInArrow(run, schema), "windows")
    rep = F.struct("row", F.col("place").alias("lo"), F.col("place").alias("hi"))
    once = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min(rep).alias("rep"))
    once = materialize(once.where("weight > 1"), "repeated_windows")
    as_units = once.select(F.col("w1").alias("anchor"), F.col("w1").alias("s1"), F.col("w2").alias("s2"), "weight", "rep")
    found = verdicts(as_units, texts, length).select(F.col("s1").alias("w1"), F.col("s2").alias("w2"))
    found = once.select("w1", "w2", "n").join(found, ["w1", "w2"])
    hits = join_counted(windows.select(*KEY, "off", "w1", "w2"), found, ["w1", "w2"], "n", F.xxhash64(*KEY, "off"))
    run_of_one = F.struct(F.col("off").alias("a"), F.col("off").alias("b"))
    return hits.groupBy(*KEY).agg(F.collect_list(run_of_one).alias("runs"))  # the windows of one stretch


def removed_spans(scanned: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(row, text, spans) of the documents that lose bytes; spans (start, end) may overlap."""
    places = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
    counted = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    places = materialize(join_counted(places, counted, ["anchor"], "n", F.col("row")).drop("n"), "places")
    texts = materialize(only_ids(rows.select("row", "text"), materialize(places.select("row").distinct(), "rows"), "row"), "texts")
    once = places.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min(F.struct("row", "lo", "hi")).alias("rep"))
    once = materialize(once, "stretches")
    size = F.col("rep.hi") - F.col("rep.lo") + length
    anchors = once.groupBy("anchor").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    units = materialize(join_counted(once, anchors, ["anchor"], "n", F.xxhash64("s1", "s2")).drop("n"), "units")
    found = verdicts(units.where(F.col("bytes") <= SHARD_BYTES), texts, length)
    wide = units.where(F.col("bytes") > SHARD_BYTES)
    if not wide.isEmpty():
        found = found.unionByName(broken_verdicts(wide, texts, length))
    found = materialize(found, "verdicts").join(once.select(*KEY, "weight"), KEY)
    hits = join_counted(places, found, KEY, "weight", F.xxhash64("row", "lo"))
    span = F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("start"), (F.col("lo") + r["b"] + length).alias("end")))
    spans = hits.groupBy("row").agg(F.flatten(F.collect_list(span)).alias("spans"))  # places of one document
    return texts.join(spans, "row")


def cut_documents(spans: DataFrame) -> DataFrame:
    """(row, n_removed, n_spans, kept): the bytes that remain of each document of :func:`removed_spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1 << 20):
            data, offsets = text_bytes(part.column("text"))
            n = np.asarray(pc.list_value_length(part.column("spans")))
            flat = pc.list_flatten(part.column("spans"))
            owner = np.repeat(np.arange(part.num_rows), n)
            edges = np.zeros(len(data) + 1, np.int32)
            for k, sign in ((0, 1), (1, -1)):
                np.add.at(edges, np.asarray(flat.field(k)) + offsets[owner], sign)
            gone = np.cumsum(edges[:-1]) > 0
            removed, n_spans, kept = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                mine = gone[a:b]
                removed.append(int(mine.sum()))
                n_spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
                kept.append(data[a:b][~mine].tobytes())
            yield pa.RecordBatch.from_pydict(
                {"row": part.column("row"), "n_removed": removed, "n_spans": n_spans, "kept": pa.array(kept, pa.binary())}
            )

    return spans.select("row", "text", "spans").mapInArrow(run, "row string, n_removed long, n_spans long, kept binary")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = MIN_LENGTH,
    gram: int = GRAM,
    keep: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document; with ``keep`` also the bytes as ``kept``.

    The kept bytes need not be UTF-8: a repeated string may begin inside a character.
    """
    row_col = free_name(docs.columns, "__row_id")
    rows = select_text(with_row_id(docs, row_col), id_col, text_col, F.col(row_col).alias("row"))
    scanned = materialize(scan(rows, length, gram), "scanned")
    cut = cut_documents(removed_spans(scanned, rows, length))
    cut = materialize(cut.withColumn("cut_sha256", F.sha2("kept", 256)), "cut")
    out = scanned.drop("places")
    if keep:
        out = out.join(rows.select("row", F.col("text").cast("binary").alias("whole")), "row")
    out = out.join(cut if keep else cut.drop("kept"), "row", "left")
    zero = F.lit(0).cast("long")
    columns = [
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.coalesce("kept", "whole").alias("kept")] if keep else []))
