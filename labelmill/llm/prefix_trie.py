"""Which conversations share which beginnings: double-array tries over ranges of prefixes.

A turn is known by 128 bits of the SHA-256 of its role and text, so no text is shuffled. A node is
known by its depth and by a 128-bit sum, over the turns before it, of a hash of (turn, depth).

* Rebuild. Turns are numbered in their conversation by a range sort and one carried count for each
  task, so a conversation of any length is spread. A conversation is then cut into segments of at
  most ``SEGMENT`` turns, each with the node it starts from.
* Shards. Segments are range-partitioned by their first turns, then by conversation: a shard holds
  neighbouring prefixes, and a prefix that many share is split over as many shards as it fills.
* Tries. A shard numbers its turns densely and packs bounded runs of segments into double arrays:
  a state's children stand at BASE[state] + turn, and CHECK names their parent. All segments walk
  the arrays together, one turn a step; the states they visit are the nodes.
* Merge. Upper nodes occur in several shards, so counts and smallest members are merged by node.
  A conversation owns the nodes whose smallest member it is: the end of its path, from some depth
  on. Told these depths, the shards walk again and add up, for each node, what its members own
  below it; as every node has one owner, the sums of the shards simply add.

Cases: rows with a null conv_id are left out; equal turn numbers of one conversation are ordered
by role, then by the digest of role and text, and equal rows stay separate turns; a conversation of
any length is cut into segments; an empty table gives an empty result (no root); other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.arrays import mix
from labelmill.llm.skew import join_counted
from labelmill.scratch import materialize

SEGMENT = 64
#: Turns packed into one double array.
TRIE_TURNS = 1 << 16
#: Turns of a segment that its shard is chosen by.
LEAD = 4
FAMILY, OWN_MOST = 5, 9
#: Free states tried for the children of a parent with several.
FIT_TRIES = 32
#: Members whose ids are joined to one piece of text before they meet.
IDS_A_PIECE = 1 << 14
NODE = ["depth", "p1", "p2"]


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, k1, k2, bytes), texts reduced to digests."""
    role_c, text_c = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role_c).cast("string"), F.lit(":"), role_c, text_c), 256)
    narrow = rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        role_c.alias("role"),
        digest.alias("digest"),
        F.octet_length(text_c).cast("long").alias("bytes"),
    ).where("conv IS NOT NULL")

    def lane(start: int) -> Column:
        return F.conv(F.substring("digest", start, 16), 16, -10).cast("long")

    return narrow.select("conv", "turn", "role", lane(1).alias("k1"), lane(17).alias("k2"), "bytes")


def wrapped_sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of all earlier values of the same run; ``heads`` marks where runs begin. Wraps at 64 bits."""
    with np.errstate(over="ignore"):
        before = np.cumsum(values) - values
        return before - before[np.flatnonzero(heads)[np.cumsum(heads) - 1]]


def with_longs(rows: DataFrame, *names: str) -> T.StructType:
    """The schema of ``rows`` and more columns of whole numbers."""
    return T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])


def running(rows: DataFrame, order: list, values: list[str], name: str) -> DataFrame:
    """``rows`` with ``before_<v>`` for each of ``values``: its sum over earlier rows of the same ``conv``.

    A range sort, so that one conversation may cover many tasks; each task adds up its rows alone,
    and one row for each task carries the sums on. Sums wrap at 64 bits. ``values`` holds ``rank``, a one.
    """
    schema = with_longs(rows, *[f"before_{v}" for v in values]).add("part", "integer")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, [np.zeros(1, np.int64)] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column("conv"))
            heads = np.append(True, conv[1:] != conv[:-1])
            goes_on = (np.cumsum(heads) == 1) & (conv[0] == last)
            columns = list(batch.columns)
            for k, v in enumerate(values):
                x = np.asarray(batch.column(v))
                before = wrapped_sums(x, heads)
                before = np.where(goes_on, before + carried[k], before)
                carried[k] = before[-1:] + x[-1:]
                columns.append(pa.array(before))
            last = conv[-1]
            columns.append(pa.array(np.full(len(conv), part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(sorted_rows.mapInArrow(add, schema), name)
    # what each task has of a conversation that covers several; there is at most one such list item a task and end
    last = F.max_by(F.struct(*[F.struct(f"before_{v}", v).alias(v) for v in values]), "before_rank").alias("last")
    spans = written.groupBy("conv", "part").agg(last)
    split = spans.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "last"))).alias("parts"))
    split = split.where(F.size("parts") > 1).select("conv", F.explode("parts").alias("p")).select("conv", "p.part", "p.last.*")

    def earlier(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        out = {"conv": table.column("conv"), "part": table.column("part")}
        for v in values:
            pair = table.column(v).combine_chunks()
            total = np.asarray(pair.field(0)) + np.asarray(pair.field(1))
            out[f"more_{v}"] = pa.array(np.cumsum(total) - total)
        return pa.table(out)

    more = "conv long, part int, " + ", ".join(f"more_{v} long" for v in values)
    carried = split.groupBy("conv").applyInArrow(earlier, more).where("more_rank > 0")
    # a task begins inside one conversation at most, so this has fewer rows than there are tasks
    joined = written.join(F.broadcast(carried), ["conv", "part"], "left")
    names = [c for c in written.columns if c != "part"]

    def plus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            for v in values:
                extra = np.asarray(pc.fill_null(batch.column(f"more_{v}"), 0))
                columns[f"before_{v}"] = pa.array(np.asarray(columns[f"before_{v}"]) + extra)
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(plus, written.select(names).schema)


def numbered(narrow: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2, bytes): turns numbered from 0 in each conversation, as a written table."""
    unsigned = [F.col(k).bitwiseXOR(F.lit(-(1 << 63))) for k in ("k1", "k2")]
    order = ["conv", F.col("turn").asc_nulls_first(), "role", *unsigned, "spread"]
    rows = narrow.withColumn("rank", F.lit(1).cast("long")).withColumn("spread", F.monotonically_increasing_id())
    placed = running(rows, order, ["rank"], "turns")
    return materialize(placed.select("conv", F.col("before_rank").alias("pos"), "k1", "k2", "bytes"), "numbered")


def rebuild(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv, n), rebuilt turns (conv, i, k1, k2, bytes)); ``i`` counts from 0."""
    head = F.struct("pos", "k1", "k2", "bytes")
    sizes = placed.groupBy("conv").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < OWN_MOST - 1, head))).alias("head"),  # eight turns at most
    )
    sizes = materialize(sizes, "sizes")
    keyed = sizes.select("conv", "n", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(OWN_MOST)).cast("int").alias("h"))
    base = sizes.select(F.col("conv").alias("base"), "head")
    family = keyed.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    taken = F.slice(F.coalesce("head", F.array().cast(sizes.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = materialize(family.join(base, "base", "left").select("conv", "n", "h", taken.alias("taken")), "families")
    first = convs.select("conv", F.explode("taken").alias("t")).select(
        "conv", F.col("t.pos").alias("i"), F.col("t.k1").alias("k1"), F.col("t.k2").alias("k2"), F.col("t.bytes").alias("bytes")
    )
    own = join_counted(placed, convs.select("conv", "n", "h", F.size("taken").alias("m")), ["conv"], "n", F.col("pos"))
    own = own.where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("i"), "k1", "k2", "bytes")
    whole = convs.select("conv", (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n"))
    return whole, first.unionByName(own)


def steps(k1: np.ndarray, k2: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a turn at ``depth`` (from 1) adds to the two sums that name a node."""
    salt = mix(depth.astype(np.int64).view(np.uint64), 3)
    return (
        mix(k1.astype(np.int64).view(np.uint64) ^ salt, 1).view(np.int64),
        mix((k2.astype(np.int64).view(np.uint64) + salt) ^ mix(k1.astype(np.int64).view(np.uint64), 4), 2).view(np.int64),
    )


def segments(rebuilt: DataFrame, length: int = SEGMENT) -> DataFrame:
    """(conv, seg, e1, e2, above, k1s, k2s, sizes): the turns of a segment, where it starts, bytes before it."""
    item = F.struct("i", "k1", "k2", "bytes")
    cut = rebuilt.withColumn("seg", F.floor(F.col("i") / length)).groupBy("conv", "seg")
    rows = cut.agg(F.sort_array(F.collect_list(item)).alias("t"))  # ``length`` turns at most
    rows = rows.select("conv", "seg", *[F.col(f"t.{c}").alias(a) for c, a in (("k1", "k1s"), ("k2", "k2s"), ("bytes", "sizes"))])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, k1, k2, sizes = flat(batch)
                first = np.cumsum(n) - n
                depth = np.arange(len(k1)) - np.repeat(first, n) + np.repeat(np.asarray(batch.column("seg")), n) * length + 1
                a, b = steps(k1, k2, depth)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *[pa.array(np.add.reduceat(x, first)) for x in (a, b, sizes)]],
                    [*batch.schema.names, "e1", "e2", "above"],
                )

    rows = materialize(rows.mapInArrow(total, with_longs(rows, "e1", "e2", "above")), "segments")
    # sums of the segments before; only conversations of several segments have any
    several = rows.groupBy("conv").agg(F.max("seg").alias("last")).where("last > 0").select("conv")
    long_ = rows.select("conv", "seg", "e1", "e2", "above", F.lit(1).cast("long").alias("rank"))
    long_ = long_.join(several.hint("shuffle_hash"), "conv", "left_semi")
    before = running(long_, ["conv", "seg"], ["rank", "e1", "e2", "above"], "entries").where("seg > 0")
    before = before.select("conv", "seg", *[F.col(f"before_{c}").alias(f"b_{c}") for c in ("e1", "e2", "above")])
    zero = F.lit(0).cast("long")
    return rows.join(before, ["conv", "seg"], "left").select(
        "conv", "seg", *[F.coalesce(f"b_{c}", zero).alias(c) for c in ("e1", "e2", "above")], "k1s", "k2s", "sizes"
    )


def shards(rows: DataFrame) -> DataFrame:
    """Segments in ranges of prefixes, as a written table."""
    lead = [F.get("k1s", F.lit(i)) for i in range(LEAD)]
    order = ["seg", "e1", *lead, "conv"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order), "shards")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(turns of each segment, k1, k2, sizes) of a batch of segments."""
    n = np.asarray(pc.list_value_length(batch.column("k1s")), np.int64)
    return n, *(np.asarray(pc.list_flatten(batch.column(c)), np.int64) for c in ("k1s", "k2s", "sizes"))


def dense(first_seen: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the distinct keys, in the order of their smallest ``first_seen``."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    earliest = np.minimum.reduceat(first_seen[order], np.flatnonzero(new))
    rank = np.empty(len(earliest), np.int64)
    rank[np.argsort(earliest)] = np.arange(len(earliest))
    out = np.empty(len(order), np.int64)
    out[order] = rank[group]
    return out


class DoubleArray:
    """Tries over dense symbols from 1: the child of ``s`` by ``c`` is BASE[s] + c, if CHECK there is ``s``.

    States 0 to ``roots`` - 1 are the roots. ``symbols[first[i] : first[i] + n[i]]`` is a sequence
    from root ``root[i]``; all are packed together, one depth at a time.
    """

    def __init__(self, root: np.ndarray, first: np.ndarray, n: np.ndarray, symbols: np.ndarray):
        roots = int(root.max(initial=-1)) + 1
        self.base, self.check = np.zeros(roots, np.int64), np.arange(roots)
        self.end = roots
        at = root.copy()
        for step in range(int(n.max(initial=0))):
            live = np.flatnonzero(n > step)
            edges = np.unique(np.stack((at[live], symbols[first[live] + step]), 1), axis=0)
            self.place(edges)
            at[live] = self.base[at[live]] + symbols[first[live] + step]

    def grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
        self.end = max(self.end, size)

    def place(self, edges: np.ndarray) -> None:
        """Choose BASE for the parents of ``edges`` (parent, symbol), sorted, and set CHECK of their children.

        Parents with several children come first: each takes the first of ``FIT_TRIES`` free states where all
        its children fit, or the end. Parents with one child then fill the states that are left free.
        """
        parents, start, n = np.unique(edges[:, 0], return_index=True, return_counts=True)
        free = np.flatnonzero(self.check[: self.end] < 0)
        for k in np.flatnonzero(n > 1).tolist():
            children = edges[start[k] : start[k] + n[k], 1]
            spread = children - children[0]
            base = self.end
            for place in free[:FIT_TRIES].tolist():
                states = place + spread
                if states[-1] < self.end and (self.check[states] < 0).all():
                    base = place
                    break
            self.grow(base + int(spread[-1]) + 1)
            self.base[parents[k]] = base - children[0]
            self.check[base + spread] = parents[k]
            free = free[self.check[free] < 0] if base in free[:FIT_TRIES] else free
        single = np.flatnonzero(n == 1)
        free = np.flatnonzero(self.check[: self.end] < 0)[: len(single)]
        more = len(single) - len(free)
        states = np.concatenate((free, np.arange(self.end, self.end + more)))
        self.grow(self.end + more)
        self.base[parents[single]] = states - edges[start[single], 1]
        self.check[states] = parents[single]

    def walk(self, root: np.ndarray, first: np.ndarray, n: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol of the sequences; all advance together."""
        out, at = np.empty(len(symbols), np.int64), root.copy()
        for step in range(int(n.max(initial=0))):
            live = np.flatnonzero(n > step)
            place = first[live] + step
            child = self.base[at[live]] + symbols[place]
            if (self.check[child] != at[live]).any():
                raise AssertionError("a sequence is not in its trie")
            at[live] = out[place] = child
        return out


def tries(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    """Bounded runs of segments, each with the arrays of its turns, among them the trie's ``state``."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("k1s")), np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TRIE_TURNS, "right")))
            part = batch.slice(lo, hi - lo)
            lo = hi
            n, k1, k2, sizes = flat(part)
            first, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            step = np.arange(len(k1)) - first[row]
            depth = np.asarray(part.column("seg"))[row] * length + step + 1
            e1, e2 = (np.asarray(part.column(c)) for c in ("e1", "e2"))
            root = dense(np.arange(len(n)), e2, e1, np.asarray(part.column("seg")))
            symbols = dense(step * len(n) + row, k2, k1) + 1
            trie = DoubleArray(root, first, n, symbols)
            heads = step == 0
            a, b = steps(k1, k2, depth)
            q1, q2 = wrapped_sums(a, heads) + e1[row], wrapped_sums(b, heads) + e2[row]
            above = wrapped_sums(sizes, heads) + np.asarray(part.column("above"))[row]
            state = trie.walk(root, first, n, symbols)
            yield part, {
                "row": row, "state": state, "depth": depth, "p1": q1 + a, "p2": q2 + b,
                "q1": q1, "q2": q2, "above": above, "bytes": sizes,
            }


def count_nodes(rows: DataFrame, length: int) -> DataFrame:
    """(depth, p1, p2, q1, q2, above, bytes, n_convs, conv_id) of every node but the root."""
    schema = "depth long, p1 long, p2 long, q1 long, q2 long, above long, bytes long, n long, conv long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in tries(batches, length):
            states, one, group = np.unique(t["state"], return_index=True, return_inverse=True)
            least = np.full(len(states), np.iinfo(np.int64).max)
            np.minimum.at(least, group, np.asarray(part.column("conv"))[t["row"]])
            columns = {c: t[c][one] for c in ("depth", "p1", "p2", "q1", "q2", "above", "bytes")}
            yield pa.RecordBatch.from_pydict(columns | {"n": np.bincount(group), "conv": least})

    rest = [F.first(c).alias(c) for c in ("q1", "q2", "above", "bytes")]  # the same in every shard
    found = rows.mapInArrow(run, schema).groupBy(*NODE)
    return found.agg(*rest, F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"))


def path_ends(rows: DataFrame, convs: DataFrame, length: int) -> DataFrame:
    """(conv, depth, p1, p2, total) for every conversation: the node of all its turns, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in tries(batches, length):
            last = np.flatnonzero(np.append(t["row"][1:] != t["row"][:-1], True))
            columns = {c: t[c][last] for c in ("depth", "p1", "p2")}
            total = t["above"][last] + t["bytes"][last]
            yield pa.RecordBatch.from_pydict({"conv": part.column("conv"), **columns, "total": total})

    schema = "conv long, depth long, p1 long, p2 long, total long"
    last = F.max(F.struct("depth", "p1", "p2", "total")).alias("e")
    with_turns = rows.mapInArrow(run, schema).groupBy("conv").agg(last).select("conv", "e.*")
    zero = F.lit(0).cast("long")
    turnless = convs.where("n = 0").select("conv", *[zero.alias(c) for c in (*NODE, "total")])
    return with_turns.unionByName(turnless)


def add_below(rows: DataFrame, length: int) -> DataFrame:
    """(depth, p1, p2, n_leaves, saved_tokens), from segments that know ``known`` and ``leaf`` of their conversation."""
    schema = "depth long, p1 long, p2 long, leaves long, saved long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in tries(batches, length):
            states, one, group = np.unique(t["state"], return_index=True, return_inverse=True)
            leaves, saved = np.zeros(len(states), np.int64), np.zeros(len(states), np.int64)
            np.add.at(leaves, group, np.asarray(part.column("leaf"))[t["row"]])
            np.add.at(saved, group, np.maximum(np.asarray(part.column("known"))[t["row"]] - t["above"], 0))
            columns = {c: t[c][one] for c in ("depth", "p1", "p2")}
            yield pa.RecordBatch.from_pydict(columns | {"leaves": leaves, "saved": saved})

    added = rows.mapInArrow(run, schema).groupBy(*NODE)
    return added.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes where conversations end.

    A digest of a list reads it in order, so the ids of a node are first joined to pieces in the
    tasks of a range sort; one task then hashes a node's pieces as they stream by.
    """

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.stack([np.asarray(batch.column(c)) for c in NODE], 1)
            conv = np.asarray(batch.column("conv"))
            new = np.append(True, (node[1:] != node[:-1]).any(1))[: len(node)]
            heads = np.flatnonzero(new)
            run = np.arange(len(node)) - heads[np.cumsum(new) - 1] if len(node) else heads
            heads = np.flatnonzero(run % IDS_A_PIECE == 0)
            ids = conv.astype(str).tolist()
            texts = [",".join(ids[a:b]) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)])]
            columns = {c: node[heads, k] for k, c in enumerate(NODE)}
            yield pa.RecordBatch.from_pydict(columns | {"first": conv[heads], "ids": pa.array(texts, pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None

        def rows(done: list) -> pa.RecordBatch:
            columns = {c: pa.array([d[0][k] for d in done], pa.int64()) for k, c in enumerate(NODE)}
            return pa.RecordBatch.from_pydict(columns | {"ends_sha256": pa.array([d[1] for d in done], pa.string())})

        for batch in batches:
            done = []
            keys = zip(*(batch.column(c).to_pylist() for c in NODE))
            for key, ids in zip(keys, batch.column("ids").to_pylist()):
                if key == at:
                    sha.update(b"," + ids.encode())
                else:
                    if sha is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(ids.encode())
            yield rows(done)
        if sha is not None:
            yield rows([(at, sha.hexdigest())])

    order = [*NODE, "conv"]
    sorted_ends = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = sorted_ends.mapInArrow(join_ids, "depth long, p1 long, p2 long, first long, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def trie_nodes(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    length: int = SEGMENT,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rebuilt = rebuild(numbered(turns(rows, conv, turn, role, text)))
    convs = materialize(convs, "conversations")
    cut = shards(segments(rebuilt, length))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*NODE, "q1", "q2", "above", "bytes")], "n_convs", "conv_id")
    nodes = materialize(count_nodes(cut, length).unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), NODE, "left")
    nodes = materialize(nodes.withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    ends = materialize(path_ends(cut, convs, length), "ends")

    # what a conversation owns: its path from the bytes ``known`` to smaller ones on, and its leaf
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("above").alias("known"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    told = ends.join(owned, "conv", "left").select(
        "conv",
        F.coalesce("known", "total").alias("known"),
        F.coalesce("leaf", zero).alias("leaf"),
        (F.floor(F.greatest(F.col("depth") - 1, zero) / length) + 1).alias("n_segments"),
    )
    told = materialize(told, "told")
    with_owned = shards(join_counted(cut, told, ["conv"], "n_segments", F.col("seg")).drop("n_segments"))
    below = add_below(with_owned, length)
    all_below = told.agg(F.sum("leaf").alias("n_leaves"), F.sum("known").alias("saved_tokens")).where("n_leaves IS NOT NULL")
    below = below.unionByName(all_below.select(*[zero.alias(c) for c in NODE], "n_leaves", "saved_tokens"))

    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("q1"),
        F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("siblings"),
    )
    named = join_counted(nodes.where("depth > 0"), parents, ["depth", "q1", "q2"], "siblings", F.col("conv_id")).drop("siblings")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = named.unionByName(top).join(below, NODE).join(id_digests(ends), NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
