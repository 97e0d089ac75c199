"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Two passes count tokens and bigrams of the training documents in numpy and deal the counts into
shards by key; only such sums are shuffled. Each shard sums its keys; its bigram counts, quantised
to powers of two, become a segment of the filter: a key of level q is inserted as (key, 1) to
(key, q), and has ``BITS_A_KEY`` bits for each of these. Segments of ``MAX_BITS`` bits or less in all are broadcast; larger ones
stay in their shards, where the distinct bigrams of each bucket of documents are brought to be asked for, with
the same result. A count is read by asking for level after level until one is missing. Token counts stay exact: each bucket of documents gets the counts of its own
tokens, as arrays.

P(w | h) = (c(h, w) + m P(w)) / (c(h) + m) with P(w) = (c(w) + 1) / (N + V + 1), where c(h, w) is
the quantised count, held to at most c(h) and c(w); the token before the first is the end token.

Cases: a null or empty text is its end token alone; null ids are training rows; without training
rows all counts are 0; repeated rows count and are scored each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.arrays import chunks, mix, range_hashes, select_text, text_bytes, word_bounds
from labelmill.llm.skew import free_name, with_row_id
from labelmill.scratch import materialize

HELD_OUT = (7, 2)
SMOOTHING = 50.0
#: Bits of a filter that is broadcast.
MAX_BITS = 1 << 29
BITS_A_KEY = 8
PROBES = 3
MAX_LEVEL = 40
#: Text in one bucket of documents, and of what is counted at once.
BUCKET_BYTES = 8 << 20
END = np.uint64(0x6A09E667F3BCC909)

COUNT_SCHEMA = "shard long, buckets binary, keys binary, counts binary"
SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first): words of each text, lower-cased, with the end token after them."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    out = np.full(len(starts) + len(first) - 1, END)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(starts)) + doc] = range_hashes(_LOWER[data], starts, ends)
    return out, first + np.arange(len(first))


def bigrams(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.concatenate(([END], ids[:-1]))[: len(ids)]
    before[first[:-1]] = END
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + ids)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys, 7) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def count_rows(rows: DataFrame, shards: int, of_bigrams: bool) -> DataFrame:
    """Counts per chunk and shard: of bigrams, or of tokens by bucket (0 where only held-out rows have one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, BUCKET_BYTES):
            ids, first = tokens(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            learn = ~np.asarray(part.column("held_out"), bool)[doc]
            if of_bigrams:
                pairs, n = np.unique(bigrams(ids, first)[learn], return_counts=True)
                shard = shard_of(pairs, shards)
                order = np.argsort(shard, kind="stable")
                yield pack(shard[order], None, pairs[order], n[order])
                continue
            bucket, shard = np.asarray(part.column("bucket"), np.int64)[doc], shard_of(ids, shards)
            order = np.lexsort((ids, bucket, shard))
            ids, bucket, shard, seen = ids[order], bucket[order], shard[order], learn[order].astype(np.uint32)
            heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])))
            yield pack(shard[heads], bucket[heads], ids[heads], np.add.reduceat(seen, heads))

    def pack(shard: np.ndarray, bucket: np.ndarray | None, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
        spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(shard)]))
        n = n.astype("<u4")
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array(shard[heads], pa.int64()),
                "buckets": pa.array([b"" if bucket is None else bucket[a:b].tobytes() for a, b in spans], pa.binary()),
                "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                "counts": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return rows.select("text", "held_out", "bucket").mapInArrow(run, COUNT_SCHEMA)


def joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def token_counts(counted: DataFrame) -> DataFrame:
    """(bucket, keys, counts): training counts of the tokens of each bucket; bucket -1 holds (N, V) of a shard."""

    def run(table: pa.Table) -> pa.Table:
        bucket, keys, n = (joined(table, c, t) for c, t in (("buckets", "i8"), ("keys", "u8"), ("counts", "<u4")))
        distinct, total = summed(keys, n.astype(np.int64))
        order = np.lexsort((keys, bucket))
        bucket, keys = bucket[order], keys[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1]))
        bucket, keys = bucket[new], keys[new]
        mine = total[np.searchsorted(distinct, keys)]
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]))
        return pa.table(
            {
                "bucket": pa.array([*bucket[heads].tolist(), -1], pa.int64()),
                "keys": pa.array([*(keys[a:b].tobytes() for a, b in spans), b""], pa.binary()),
                "counts": pa.array([*(mine[a:b].tobytes() for a, b in spans), b""], pa.binary()),
                "n": pa.array([*[0] * len(spans), int(total.sum())], pa.int64()),
                "v": pa.array([*[0] * len(spans), int((total > 0).sum())], pa.int64()),
            }
        )

    rows = counted.groupBy("shard")
    return rows.applyInArrow(run, "bucket long, keys binary, counts binary, n long, v long")


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts).astype(np.int64) + 1, MAX_LEVEL)


def middle(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range, 0 for level 0."""
    return np.where(levels > 0, (3 * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def positions(keys: np.ndarray, levels: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    h = mix(keys + levels.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 3)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) % bits).astype(np.int64) for i in range(PROBES)]


def segment(table: pa.Table, most: int | None = None) -> bytes | None:
    """The filter of one shard's bigrams; None if it has more than ``most`` bits."""
    keys, n = summed(joined(table, "keys", "u8"), joined(table, "counts", "<u4").astype(np.int64))
    top = level(n)
    bits = 8 * max(1, BITS_A_KEY * int(top.sum()) // 8)
    if most is not None and bits > max(8, most):
        return None
    flags = np.zeros(bits, bool)
    for q in range(1, int(top.max(initial=0)) + 1):
        mine = keys[top >= q]
        for place in positions(mine, np.full(len(mine), q), np.uint64(bits)):
            flags[place] = True
    return np.packbits(flags).tobytes()


def segments(counted: DataFrame, most: int) -> DataFrame:
    """(shard, bits): the filter of each shard's bigrams, null for those of more than ``most`` bits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([segment(table, most)], pa.binary())})

    return counted.groupBy("shard").applyInArrow(run, "shard long, bits binary")


def asked_levels(rows: DataFrame, shards: int) -> DataFrame:
    """(bucket, keys, levels): levels of the distinct bigrams of each bucket's documents, asked for in their shards."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, BUCKET_BYTES):
            ids, first = tokens(part.column("text"))
            bucket = np.repeat(np.asarray(part.column("bucket"), np.int64), np.diff(first))
            keys = bigrams(ids, first)
            shard = shard_of(keys, shards)
            order = np.lexsort((keys, bucket, shard))
            keys, bucket, shard = keys[order], bucket[order], shard[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1]))[: len(keys)]
            keys, bucket, shard = keys[new], bucket[new], shard[new]
            heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
            spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(shard)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(shard[heads], pa.int64()),
                    "buckets": pa.array([bucket[a:b].tobytes() for a, b in spans], pa.binary()),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                }
            )

    def answer(counted: pa.Table, wanted: pa.Table) -> pa.Table:
        bits = segment(counted) if counted.num_rows else b""
        bucket, keys = joined(wanted, "buckets", "i8"), joined(wanted, "keys", "u8")
        order = np.argsort(bucket, kind="stable")
        bucket, keys = bucket[order], keys[order]
        levels = CountFilter({0: bits}, 1).levels(keys).astype("u1")
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)]))
        return pa.table(
            {
                "bucket": pa.array(bucket[heads], pa.int64()),
                "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                "levels": pa.array([levels[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    wanted = rows.select("text", "bucket").mapInArrow(asked, "shard long, buckets binary, keys binary")
    counted = count_rows(rows, shards, of_bigrams=True).groupBy("shard")
    return counted.cogroup(wanted.groupBy("shard")).applyInArrow(answer, "bucket long, keys binary, levels binary")


class CountFilter:
    """The log-frequency Bloom filter: all segments one after another."""

    def __init__(self, parts: dict[int, bytes], shards: int):
        sizes = np.array([len(parts.get(s, b"")) for s in range(shards)], np.int64)
        self.shards, self.bits = shards, 8 * sizes
        self.starts = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), np.uint8)

    def has(self, keys: np.ndarray, q: int) -> np.ndarray:
        shard = shard_of(keys, self.shards)
        bits, start = self.bits[shard], self.starts[shard]
        out = bits > 0
        for place in positions(keys, np.full(len(keys), q), np.maximum(bits, 1).astype(np.uint64)):
            at = np.minimum(start + (place >> 3), max(len(self.data) - 1, 0))
            out &= (self.data[at] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0 if len(self.data) else False
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, MAX_LEVEL + 1):
            open_ = open_[self.has(keys[open_], q)]
            if not len(open_):
                break
            out[open_] = q
        return out


def score(
    docs: DataFrame,
    smoothing: float = SMOOTHING,
    max_bits: int = MAX_BITS,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    row_col = free_name(docs.columns, "__row_id")
    rows = select_text(with_row_id(docs, row_col), id_col, text_col, F.col(row_col).alias("place"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1]
    rows = rows.withColumn("held_out", F.coalesce(held, F.lit(False)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    known = materialize(token_counts(count_rows(rows, buckets, of_bigrams=False)), "token_counts")
    total = known.where("bucket = -1").agg(F.sum("n"), F.sum("v")).first()
    n_train, n_distinct = total[0] or 0, total[1] or 0
    own = known.where("bucket >= 0").select("bucket", "keys", "counts")
    # one job for all segments; those of more than their part of max_bits come back as null
    parts = dict(segments(count_rows(rows, buckets, of_bigrams=True), max_bits // buckets).collect())
    sent = all(bits is not None for bits in parts.values())
    if sent:
        shared = docs.sparkSession.sparkContext.broadcast(CountFilter(parts, buckets))
        own = own.withColumn("levels", F.lit(None).cast("binary"))
    else:
        shared = None
        own = own.withColumn("levels", F.lit(None).cast("binary")).unionByName(
            asked_levels(rows, buckets).select("bucket", "keys", F.lit(None).cast("binary").alias("counts"), "levels")
        )

    def levels_of(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        if shared is not None:
            return shared.value.levels(keys)
        known, levels = joined(answers, "keys", "u8"), joined(answers, "levels", "u1")
        order = np.argsort(known)
        return levels[order][np.searchsorted(known[order], keys)].astype(np.int64) if len(keys) else np.zeros(0, np.int64)

    def run(part: pa.Table, mine: pa.Table) -> pa.Table:
        is_count = mine.column("counts").is_valid()
        mine, answers = mine.filter(is_count), mine.filter(mine.column("levels").is_valid())
        ids, first = tokens(part.column("text").combine_chunks())
        keys, counts = joined(mine, "keys", "u8"), joined(mine, "counts", "i8")
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        c = counts[np.searchsorted(keys, ids)] if len(ids) else np.zeros(0, np.int64)
        end_count = counts[np.searchsorted(keys, END)]
        before = np.concatenate(([end_count], c[:-1]))[: len(c)]
        before[first[:-1]] = end_count
        single = (c + 1) / (n_train + n_distinct + 1)
        pairs = np.zeros(len(ids))
        ask = (c > 0) & (before > 0)
        distinct, back = np.unique(bigrams(ids, first)[ask], return_inverse=True)
        pairs[ask] = np.minimum(middle(levels_of(distinct, answers))[back], np.minimum(c, before)[ask])
        model = (pairs + smoothing * single) / (before + smoothing)
        add = np.add.reduceat
        return pa.table(
            {
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "n_tokens": pa.array(np.diff(first)),
                "n_known": pa.array(add((c > 0).astype(np.int64), first[:-1])),
                "train_tokens": pa.array(np.full(part.num_rows, n_train, np.int64)),
                "base_score": pa.array(add(np.log10(single), first[:-1])),
                "score": pa.array(add(np.log10(model), first[:-1])),
            }
        )

    texts = rows.select("bucket", "doc_id", "held_out", "text").groupBy("bucket")
    return texts.cogroup(own.groupBy("bucket")).applyInArrow(run, SCORE_SCHEMA)
