"""Near-duplicates by ProbMinHash over weighted word shingles, banding, and exact verification.

A text is the set of its runs of five words, each weighted 1 + ln(times it occurs). Every shingle
sends points to the registers as a Poisson process whose rate is its weight; a register keeps the
earliest point, and a shingle stops once its next point is later than all registers have. Two
texts agree in a register with probability J_P, their probability Jaccard similarity. Registers
form bands; texts that share a band are compared exactly, and those with J_P of 0.8 or more are
linked. Classes are the components of the links.

Texts with the same words are one node before anything else. In a bucket of up to ``SMALL``
nodes all are compared; in a larger one every node is compared first with four pivots (smallest,
largest, first by a hash, and the one in the largest buckets of all bands), which connects most
groups in linear work. A large bucket that is not one class after that is split by a hash into
blocks, and its nodes of different classes are compared block against block, in the first band
they share, so every two nodes of a bucket are in one class or were compared. That is quadratic
only in what the pivots left apart. A text of fewer than five words is one shingle, its whole
word sequence.

Cases: null and empty texts have no words and are copies of each other; repeated rows are copies;
the row with the smallest id of a class stays, null ids last, then by row id; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.arrays import SMALL_CHUNK, chunks, gram_starts, mix, range_hashes, select_text, text_bytes, word_bounds
from labelmill.llm.components import components
from labelmill.llm.skew import join_counted, with_row_id
from labelmill.scratch import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SMALL = 8
#: Nodes, and shingles of all nodes, that one block of a large bucket holds on average.
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
#: Shingles that are multiplied at once.
BLOCK_COLUMNS = 4096
#: Column with an id per row, made from its place in its file unless the caller has one.
ROW_COL = "__row_id"
#: Ids up to this number are sent to all tasks to find the texts to compare; more are shuffled.
SENT_IDS = 1_000_000


def shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, count, digests): the distinct shingles of each text, and two hashes of its words."""
    data, offsets = text_bytes(part.column("text"))
    starts, ends, first = word_bounds(data, offsets)
    words = range_hashes(data, starts, ends)
    digests = np.stack([mix(range_hashes(words, first[:-1], first[1:], w)) for w in (0, 1)])
    at, doc = gram_starts(first, SHINGLE_WORDS)
    grams = range_hashes(words, at, at + SHINGLE_WORDS)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE_WORDS))
    doc, grams = np.concatenate((doc, short)), np.concatenate((grams, digests[0][short]))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1]))[: len(doc)]
    heads = np.flatnonzero(new)
    return doc[heads], grams[heads], np.diff(np.append(heads, len(doc))), digests


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def sketch(doc: np.ndarray, grams: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """(texts x registers) shingles whose points come first; 0 where a text has none."""
    earliest = np.full(n_texts * registers, np.inf)
    kept = np.zeros(n_texts * registers, np.uint64)
    time, nth = np.zeros(len(doc)), 0
    while len(doc):
        nth += 1
        draw = mix(grams, nth)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        slot = doc * registers + (mix(draw, 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        first = time == earliest[slot]
        kept[slot[first]] = grams[first]
        open_ = time < earliest.reshape(n_texts, registers).max(axis=1)[doc]
        doc, grams, weight, time = doc[open_], grams[open_], weight[open_], time[open_]
    return kept.reshape(n_texts, registers)


def band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) hashes of the registers in each band."""
    parts = mix(kept).reshape(len(kept), bands, rows)
    factors = mix(np.arange(rows, dtype=np.uint64)) | np.uint64(1)
    return mix((parts * factors).sum(axis=2) + mix(np.arange(bands, dtype=np.uint64)))


def sketches(docs: DataFrame, row_col: str, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row_id, doc_id, d1, d2, n_shingles, bands) of each row; no bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SMALL_CHUNK):
            doc, grams, counts, digests = shingles(part)
            n = np.bincount(doc, minlength=part.num_rows)
            keys = band_keys(sketch(doc, grams, weights(counts), part.num_rows, bands * rows), bands, rows)
            ends = np.cumsum(np.append(0, np.where(n > 0, bands, 0))).astype(np.int32)
            flat = keys[n > 0].ravel().view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "row_id": part.column("row_id"),
                    "doc_id": part.column("doc_id"),
                    "d1": pa.array(digests[0].view(np.int64)),
                    "d2": pa.array(digests[1].view(np.int64)),
                    "n_shingles": pa.array(n),
                    "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                }
            )

    texts = select_text(docs, id_col, text_col, F.col(row_col).alias("row_id"))
    return texts.mapInArrow(run, "row_id string, doc_id long, d1 long, d2 long, n_shingles long, bands array<long>")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that share a band: all of a small bucket, four pivots of a larger one.

    Also (band, key, node) of the larger buckets.
    """
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = (
        keys.groupBy("band", "key")
        .agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where("n > 1")
    )
    shared = materialize(join_counted(keys, buckets, ["band", "key"], "n", F.col("node")), "buckets")
    large = shared.where(F.col("n") > SMALL)
    reach = large.groupBy("node").agg(F.sum("n").alias("reach"))
    chosen = (
        large.join(reach, "node")
        .groupBy("band", "key")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.xxhash64("node").alias("mixed"), "node"))["node"].alias("third"),
            F.max(F.struct("reach", "node"))["node"].alias("central"),
        )
    )
    chosen = materialize(chosen, "pivots")
    pivots = large.select("node", F.explode(F.array("low", "high")).alias("b")).unionByName(
        join_counted(large.select("band", "key", "node"), chosen, ["band", "key"], "n", F.col("node")).select(
            "node", F.explode(F.array("third", "central")).alias("b")
        )
    )
    few = shared.where(F.col("n") <= SMALL).groupBy("band", "key").agg(F.collect_list("node").alias("all"))
    inside = few.select(F.explode("all").alias("node"), "all").select("node", F.explode("all").alias("b"))
    pairs = pivots.unionByName(inside).where("node <> b")
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), large.select("band", "key", "node")


def similarity(x: np.ndarray, x_counts: np.ndarray, y: np.ndarray, y_counts: np.ndarray) -> float:
    """Exact J_P of two sorted arrays of distinct shingles with their counts."""
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    n_both = int(both.sum())
    if x_counts.max() == 1 and y_counts.max() == 1:
        return n_both / (len(x) + len(y) - n_both)
    u, v = weights(x_counts), weights(y_counts)
    pairs, n = np.unique(np.stack((u[both], v[at[both]])), axis=1, return_counts=True)
    alone_x = u[~both].sum()
    only_y = np.ones(len(y), bool)
    only_y[at[both]] = False
    alone_y = v[only_y].sum()
    total = 0.0
    for (a, b), k in zip(pairs.T, n):
        total += k / ((n * np.maximum(pairs[0] / a, pairs[1] / b)).sum() + alone_x / a + alone_y / b)
    return float(total)


def shingle_sets(wanted: DataFrame, docs: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """(node, grams, counts) of the nodes in ``wanted`` (node, row_id)."""
    wanted = materialize(wanted.select("node", F.col("row_id").alias(row_col)), "compared")
    side = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted.hint("shuffle_hash")
    texts = docs.select(row_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(side, row_col).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SMALL_CHUNK):
            doc, grams, counts, _ = shingles(part)
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
            spans = list(zip(bounds, bounds[1:]))
            yield pa.RecordBatch.from_pydict(
                {
                    "node": part.column("node"),
                    "grams": pa.array([grams[a:b].tobytes() for a, b in spans], pa.binary()),
                    "counts": pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                }
            )

    return materialize(texts.mapInArrow(sets, "node long, grams binary, counts binary"), "shingle_sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, row_col: str, text_col: str, least: float) -> DataFrame:
    """The ``pairs`` whose exact similarity is ``least`` or more."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    found = shingle_sets(wanted, docs, row_col, text_col)
    load = pairs.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    right = found.join(load, "node").select(F.col("node").alias("b"), "n", F.col("grams").alias("y"), F.col("counts").alias("y_counts"))
    load = pairs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    left = found.join(load, "node").select(F.col("node").alias("a"), "n", F.col("grams").alias("x"), F.col("counts").alias("x_counts"))
    one = join_counted(pairs, left, ["a"], "n", F.col("b")).drop("n")
    rows = join_counted(one, right, ["b"], "n", F.col("a")).drop("n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = [part.column(c) for c in ("x", "x_counts", "y", "y_counts")]
            same = []
            for i in range(part.num_rows):
                x, xc, y, yc = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(columns, ("u8", "i4", "u8", "i4")))
                fits = min(len(x), len(y)) > 0
                same.append(fits and similarity(x, xc, y, yc) >= least)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return rows.select("a", "b", "x", "x_counts", "y", "y_counts").mapInArrow(compare, "a long, b long")


def shared_mass(grams: list[np.ndarray], counts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left x right) the smaller of the shares of weight that two sets have in shingles of both: J_P is at most that."""
    norm = [w / w.sum() for w in map(weights, counts)]
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    share = np.concatenate(norm)
    twice = n[column] > 1
    column, owner, share = (np.cumsum(n > 1) - 1)[column[twice]], owner[twice], share[twice]
    order = np.argsort(column, kind="stable")
    column, owner, share = column[order], owner[order], share[order]
    x, y = np.zeros((2, len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + BLOCK_COLUMNS))
        dense = np.zeros((len(grams), BLOCK_COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - lo] = share[a:b]
        has = (dense > 0).astype(np.float32)
        x += dense[left] @ has[right].T
        y += has[left] @ dense[right].T
    return np.minimum(x, y)


def links_between(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Links that connect nodes of different labels within one block, or between two blocks of a bucket."""
    grams, counts = ([np.frombuffer(v.as_buffer(), t) for v in table.column(c)] for c, t in (("grams", "u8"), ("counts", "i4")))
    node, label, block = (np.asarray(table.column(c)) for c in ("node", "label", "block"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    one, band = block.min() == block.max(), table.column("band")[0].as_py()
    if one and not table.column("lo")[0] == table.column("hi")[0]:
        return []  # the other block is empty
    left = np.flatnonzero(block == block.min())
    right = left if one else np.flatnonzero(block != block.min())
    open_ = shared_mass(grams, counts, left, right) >= least - 1e-3
    open_ &= label[left][:, None] != label[right][None, :]
    if one:
        open_ = np.triu(open_, 1)
    i, j = np.nonzero(open_)
    i, j = left[i], right[j]
    here = bands[i, band] == bands[j, band]
    for earlier in range(band):  # the pair is compared in that band
        here &= bands[i, earlier] != bands[j, earlier]
    above = {v: v for v in label.tolist()}

    def top(v: int) -> int:
        while above[v] != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    links = []
    for a, b in zip(i[here].tolist(), j[here].tolist()):
        u, v = top(int(label[a])), top(int(label[b]))
        if u != v and similarity(grams[a], counts[a], grams[b], counts[b]) >= least:
            above[u] = v
            links.append((int(node[a]), int(node[b])))
    return links


def links_left(
    large: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, row_col: str, text_col: str, least: float
) -> DataFrame | None:
    """Links (a, b) inside large buckets between nodes that ``labels`` holds apart; None if each bucket is one class.

    Nodes of a bucket's most frequent label are not compared with each other; the few others are
    compared with all.
    """
    per_node = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n_shingles")
    marked = large.join(per_node, "node")
    parts = marked.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    split = parts.groupBy("band", "key").agg(
        F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels")
    )

    def blocks(n: str, size: str) -> Column:
        return F.ceil(F.greatest(F.expr(n) / BLOCK, F.expr(size) / BLOCK_SHINGLES)).cast("int")

    split = split.where("labels > 1").select(
        "band", "key", "n", "top.label", blocks("n - top.n", "size - top.size").alias("others"), blocks("top.n", "top.size").alias("tops")
    )
    split = materialize(split.withColumnRenamed("label", "top"), "split_buckets")
    if split.isEmpty():
        return None
    rows = join_counted(marked.drop("n_shingles"), split, ["band", "key"], "n", F.col("node")).drop("n")
    mixed = F.xxhash64("node")
    is_top = F.col("label") == F.col("top")
    rows = rows.withColumn(
        "block", F.when(is_top, F.col("others") + F.pmod(mixed, "tops")).otherwise(F.pmod(mixed, "others")).cast("int")
    )
    last = F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(
        "band", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label"
    )
    rows = materialize(rows, "blocks")
    wanted = rows.select("node").distinct().join(nodes, "node")
    sets = shingle_sets(wanted, docs, row_col, text_col).join(nodes.select("node", "bands"), "node")

    def run(table: pa.Table) -> pa.Table:
        links = links_between(table, least)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    found = rows.join(sets, "node").groupBy("band", "key", "lo", "hi").applyInArrow(run, "a long, b long")
    return materialize(found, "links")


def near_dedup(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row per document: (row_id, doc_id, class_id, class_size, copies, kept).

    ``class_id`` is the id of the class's row that stays, ``copies`` how many rows have the same words.
    """
    keyed = docs if row_col else with_row_id(docs, ROW_COL)
    row_col = row_col or ROW_COL
    rows = materialize(sketches(keyed, row_col, id_col, text_col), "sketches")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    groups = rows.groupBy("d1", "d2").agg(
        F.min(best).alias("best"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles")
    )
    nodes = materialize(
        groups.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "best", "copies", "bands", "n_shingles", "best.row_id"), "nodes"
    )
    pairs, large = candidates(nodes)
    pairs = materialize(pairs, "candidates")
    links = materialize(verified(pairs, nodes, keyed, row_col, text_col, least), "links")
    labels = components(links)
    more = links_left(large, labels, nodes, keyed, row_col, text_col, least)
    if more is not None and not more.isEmpty():
        labels = components(links.unionByName(more))
    labelled = nodes.select("node", "d1", "d2", "best", "copies").join(labels, "node", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(F.min("best").alias("keep"), F.sum("copies").alias("class_size"), F.count("*").alias("members"))
    per_text = materialize(
        join_counted(labelled.drop("best"), classes, ["label"], "members", F.col("node")).select(
            "d1", "d2", "copies", "class_size", F.col("keep.doc_id").alias("class_id"), F.col("keep.row_id").alias("keep_row")
        ),
        "classes",
    )
    joined = join_counted(rows.select("row_id", "doc_id", "d1", "d2"), per_text, ["d1", "d2"], "copies", F.col("row_id"))
    return joined.select(
        "row_id", "doc_id", "class_id", "class_size", "copies", (F.col("row_id") == F.col("keep_row")).alias("kept")
    )
