"""Softmax regression on words, trained in mini-batch steps of Spark jobs.

Texts are encoded once: words become numbers, the most frequent ones the smallest, 0 the empty word, which
stands for the bias. A step scores one batch, sums each word's share of the error, and makes new
weights; so training can go on from any weights, epoch after epoch, and nothing but the weights is carried.
A text's words weigh 1 / sqrt(number of its words) each.

Weights of the most frequent words, a bounded number of bytes, are an array that is sent to the tasks, and
tasks score and sum where the text lies, in Arrow. Those of the other words stay a table, which is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.functions.scores import with_softmax
from labelmill.functions.text import words
from labelmill.operators.tokens import with_dense_ids
from labelmill.operators.word_lookup import with_word_ids
from labelmill.scratch import lookup_join, materialize

# Training defaults.
EPOCHS = 8
LEARNING_RATE = 2.0
L2 = 0.01
WARM_UP_STEPS = 2
BATCHES = 4
#: Each class is a column of the sums, so there must not be too many of them.
MAX_CLASSES = 256
#: Weights sent to every task; it only places the work.
NEAR_BYTES = 128 * 1024 * 1024
#: The rest of a vocabulary is broadcast below this, as the driver holds it in memory, weights beside it.
REST_BYTES = 64 * 1024 * 1024
#: Words of texts handled at once, and rows of sums in a batch.
SLICE_WORDS = 1 << 20
SUM_ROWS = 1 << 16
#: Stands for a word in the sums of a step, to count the texts.
_TEXTS = -1


@dataclass(frozen=True)
class Schedule:
    """Steps of gradient descent: ``batches`` an epoch, the rate rising in a line over the first ``warm_up`` steps."""

    rate: float = LEARNING_RATE
    l2: float = L2
    warm_up: int = WARM_UP_STEPS
    batches: int = BATCHES
    seed: int = 42

    def rate_at(self, step: int) -> float:
        """Rate of a step, counted from 1 over all epochs."""
        return self.rate * min(1.0, step / self.warm_up) if self.warm_up else self.rate


@dataclass(frozen=True)
class Terms:
    """Encoded texts."""

    rows: DataFrame  # written (*keep, x, ids): ids are the int32 numbers of the known words
    words: DataFrame  # written (token, word_id), the empty word among them
    size: int  # of words
    unique: bool  # no id is null or comes twice


@dataclass(frozen=True)
class Weights:
    """Weights of numbered words: those below ``cells`` in an array, the others in a table."""

    near: np.ndarray  # a row per class, a column per word, and a last column of zeros
    far: DataFrame | None = None  # written (word_id, w); a word that is not there weighs nothing

    @property
    def cells(self) -> int:
        return self.near.shape[1] - 1

    def table(self, terms: Terms) -> DataFrame:
        """(token, w)"""
        k, n = len(self.near), self.cells
        ends = pa.array(np.arange(0, n * k + 1, k), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(self.near[:, :n].T.ravel()))
        near = pa.table({"word_id": pa.array(np.arange(n), pa.int32()), "w": lists})
        by_id = terms.words.sparkSession.createDataFrame(near)
        by_id = by_id if self.far is None else by_id.union(self.far)
        return terms.words.join(by_id, "word_id").select("token", "w")


def word_weights(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(*keep, tokens, x): the words of each text and the weight of each of them; the empty word, of weight 1, goes without saying."""
    found = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    share = F.lit(1.0) / F.sqrt(F.greatest(F.size("tokens"), F.lit(1)).cast("double"))
    return df.select(*keep, found.alias("tokens")).select(*keep, "tokens", share.alias("x"))


def encode(rows: DataFrame, like: Terms | None = None, weights: DataFrame | None = None) -> Terms:
    """Texts of :func:`word_weights` (their id comes first) with numbers for words, written.

    The numbers are those of ``like``; else all words of ``rows`` and of the table ``weights`` get new ones.
    """
    id, size = rows.columns[0], like and like.size
    if like is None:
        # a text without id takes no part in training
        counted = rows.where(F.col(id).isNotNull()).select(F.explode("tokens").alias("token")).groupBy("token").count()
        if weights is not None:
            counted = counted.union(weights.where("token <> ''").select("token", F.lit(0).cast("bigint")))
            counted = counted.groupBy("token").agg(F.sum("count").alias("count"))
        numbered = with_dense_ids(counted, [F.desc("count"), F.asc("token")], "word_id", start=1)
        bias = rows.sparkSession.createDataFrame([("", 0)], "token string, word_id int")
        table = materialize(numbered.select("token", "word_id").union(bias), "vocabulary")
        size = table.count()
    else:
        table = like.words
    known = table.select(F.col("token").alias("word"), "word_id", F.array("word_id").alias("ids"))
    found = with_word_ids(rows, "tokens", known, -F.col("word_id"), size, "ids", max_bytes=REST_BYTES)
    packed = T.StructType([*[f for f in found.schema if f.name != "ids"], T.StructField("ids", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists)))).astype(np.int64)
            values = np.asarray(lists.flatten()).astype(np.int32)
            is_known = values < size
            ends = np.append(0, np.cumsum(is_known))[ends] * 4
            parts = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values[is_known])]
            ids = pa.Array.from_buffers(pa.binary(), len(lists), parts)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in packed[:-1]], ids], packed.names)

    out = materialize(found.mapInArrow(pack, packed), "terms")
    n, ids = out.agg(F.count("*"), F.count_distinct(id)).first()
    return Terms(out, table, size, n == ids)


def batch_of(id: str, epoch: int, schedule: Schedule) -> Column:
    """The batch of a row in an epoch; each epoch deals the rows anew."""
    return F.pmod(F.xxhash64(F.lit(schedule.seed), F.lit(epoch), F.col(id)), F.lit(schedule.batches))


def _cells(size: int, k: int, max_bytes: int) -> int:
    return min(size, max(1, max_bytes // (8 * k)))


def _placed(table: DataFrame, terms: Terms, k: int, max_bytes: int) -> Weights:
    """Weights of a table (token, w), for the numbers of ``terms``."""
    n = _cells(terms.size, k, max_bytes)
    by_id = materialize(table.join(terms.words, "token").select("word_id", "w"), "weights")
    found = by_id.where(F.col("word_id") < n).toArrow()
    near = np.zeros((k, n + 1))
    near[:, np.asarray(found.column("word_id"))] = np.asarray(found.column("w").combine_chunks().flatten()).reshape(-1, k).T
    return Weights(near, by_id.where(F.col("word_id") >= n) if terms.size > n else None)


def _on_tasks() -> tuple[Callable, Callable]:
    """(slices, scores), made here so that they travel with the functions that call them."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, numbers of their words, words of each row, x)"""
        for batch in batches:
            column = batch.column("ids").cast(pa.large_binary())
            _, ends, data = column.buffers()
            ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] // 4
            values = np.frombuffer(data, np.int32, int(ends[-1])) if len(column) and ends[-1] else np.zeros(0, np.int32)
            x, begin = np.asarray(batch.column("x")), 0
            while begin < len(column):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_WORDS, "right")) - 1)
                ids = values[ends[begin] : ends[end]].astype(np.intp)
                yield batch.slice(begin, end - begin), ids, np.diff(ends[begin : end + 1]), x[begin:end]
                begin = end

    def scores(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(table), len(sizes)))  # of numpy's own dtype object: with that of a sent array np.add.at takes ten times as long
        out[:] = table[:, :1]
        filled = sizes > 0
        begins = (np.cumsum(sizes) - sizes)[filled]
        if len(begins):
            for c, w in enumerate(table):
                out[c, filled] += np.add.reduceat(w[ids], begins) * x[filled]
        return out

    return slices, scores


def logits(
    rows: DataFrame | Terms, weights: DataFrame | Weights | None, k: int, keep: Sequence[str], max_bytes: int = NEAR_BYTES
) -> DataFrame:
    """(*keep, scores) per text, written; words without weights count nothing. Texts of the same ``keep[0]`` are one.

    ``rows`` and ``weights`` are tables, those of :func:`word_weights` and (token, w), or :class:`Terms` and :class:`Weights`.
    """
    if k > MAX_CLASSES:
        raise ValueError(f"{k} classes, at most {MAX_CLASSES}")
    id, *rest = keep
    columns = [f"_s{c}" for c in range(k)]
    carried = [F.first(c).alias(c) for c in rest]
    if weights is None:
        texts = rows.rows if isinstance(rows, Terms) else rows
        found = texts.groupBy(id).agg(*carried).select(*keep, F.array(*[F.lit(0.0)] * k).alias("scores"))
        return materialize(found, "scores")
    if not isinstance(rows, Terms):
        rows = encode(rows.select(*keep, "tokens", "x"), weights=weights)
        weights = _placed(weights, rows, k, max_bytes)
    texts = rows.rows.select(*keep, "x", "ids")
    fields = [texts.schema[c] for c in (*keep, "x")]
    names, cells = [f.name for f in fields], weights.cells
    out = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in columns], T.StructField("far", T.ArrayType(T.IntegerType()))])
    sent = rows.rows.sparkSession.sparkContext.broadcast(weights.near)
    slices, scores = _on_tasks()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, sizes, x in slices(batches):
            found = scores(sent.value, np.minimum(ids, cells), sizes, x)
            far = ids >= cells
            ends = np.append(0, np.cumsum(far))[np.append(0, np.cumsum(sizes))]
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[far], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *map(pa.array, found), others], out.names)

    summed = texts.mapInArrow(score, out)
    if weights.far is not None:
        summed = materialize(summed, "near-scores")
        others = summed.where(F.size("far") > 0).select(*keep, "x", F.explode("far").alias("word_id"))
        met = lookup_join(others, weights.far, "word_id", id, "inner", max_bytes)
        summed = summed.select(*keep, *columns).union(
            met.groupBy(id).agg(*carried, *[F.sum(F.get("w", F.lit(c)) * F.col("x")).alias(f"_s{c}") for c in range(k)]).select(*keep, *columns)
        )
    summed = summed.groupBy(id).agg(*carried, *[F.sum(c).alias(c) for c in columns])
    written = materialize(summed.select(*keep, F.array(*columns).alias("scores")), "scores")
    sent.destroy()
    return written


def _slopes(batch: DataFrame, k: int, cells: int, sent: object | None) -> DataFrame:
    """(word_id, g0, g1, ...): the error summed per word and class over the texts of ``batch``, and their number as g0 of ``_TEXTS``.

    With weights, ``sent``, of all words errors come of the scores they give; else they are in column ``e``.
    """
    names = ["word_id", *[f"g{c}" for c in range(k)]]
    slices, scores = _on_tasks()

    def sums_of(words: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(words), SUM_ROWS):
            part = slice(begin, begin + SUM_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.int32()), *[pa.array(s[part]) for s in sums]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met, texts = np.zeros((k, cells)), np.zeros(cells, bool), 0
        for part, ids, sizes, x in slices(batches):
            n = len(sizes)
            if sent is None:
                error = np.asarray(part.column("e").flatten()).reshape(n, k).T
            else:
                z = scores(sent.value, ids, sizes, x)
                error = np.exp(z - z.max(axis=0))
                error /= error.sum(axis=0)
                error[np.asarray(part.column("class_id")), np.arange(n)] -= 1.0
            texts += n
            sums[:, 0] += error.sum(axis=1)
            far = ids >= cells
            near = ids[~far] if (some := far.any()) else ids
            met[near] = True
            if some:
                words, at = np.unique(ids[far], return_inverse=True)
                others = np.zeros((k, len(words)))
            for c in range(k):
                share = np.repeat(error[c] * x, sizes)
                np.add.at(sums[c], near, share[~far] if some else share)
                if some:
                    others[c] = np.bincount(at, share[far])
            if some:
                yield from sums_of(words, others)
        if texts:
            met[0] = True
            words = np.flatnonzero(met)
            yield from sums_of(np.append(words, _TEXTS), np.append(sums[:, words], np.full((k, 1), float(texts)), axis=1))

    schema = T.StructType([T.StructField("word_id", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names[1:]]])
    return batch.mapInArrow(run, schema).groupBy("word_id").agg(*[F.sum(c).alias(c) for c in names[1:]])


def step(batch: Terms, weights: Weights, k: int, rate: float, l2: float) -> Weights:
    """New weights after one step on ``batch`` (id, class_id, x, ids)."""
    cells, sent = weights.cells, None
    if batch.unique and batch.size <= cells:
        sent = batch.rows.sparkSession.sparkContext.broadcast(weights.near)
        sums = _slopes(batch.rows, k, cells, sent)
    else:
        scored = with_softmax(logits(batch, weights, k, ["id", "class_id"]), "scores", "p")
        wrong = F.transform("p", lambda p, c: p - F.when(c == F.col("class_id"), 1.0).otherwise(0.0))
        errors = materialize(scored.select("id", wrong.alias("e")), "errors")
        n = errors.count()
        if not n:
            return weights
        joined = lookup_join(batch.rows.select("id", "x", "ids"), errors, "id", "ids", "inner")
        sums = materialize(_slopes(joined.select("x", "ids", "e"), k, cells, None), "slopes")
    found = sums.where(F.col("word_id") < cells).toArrow()
    ids = np.asarray(found.column("word_id"))
    is_word = ids != _TEXTS
    if sent is not None:
        sent.destroy()
        n = np.asarray(found.column("g0"))[~is_word].sum()
        if not n:
            return weights
    near = weights.near * (1.0 - rate * l2)
    for c in range(k):
        near[c, ids[is_word]] -= rate / n * np.asarray(found.column(f"g{c}"))[is_word]
    del found
    pa.default_memory_pool().release_unused()
    if batch.size <= cells:
        return Weights(near)
    zeros = F.array_repeat(F.lit(0.0), k)
    far = sums.where(F.col("word_id") >= cells).select("word_id", F.array(*[f"g{c}" for c in range(k)]).alias("g"))
    both = far.withColumn("w", zeros) if weights.far is None else weights.far.join(far, "word_id", "full")
    shrink, move = F.lit(1.0 - rate * l2), F.lit(rate / n)
    new = F.zip_with(F.coalesce("w", zeros), F.coalesce("g", zeros), lambda w, g: w * shrink - move * g)
    return Weights(near, materialize(both.select("word_id", new.alias("w")), "weights"))


def run_epoch(
    rows: DataFrame | Terms,
    weights: DataFrame | Weights | None,
    k: int,
    epoch: int,
    schedule: Schedule,
    max_bytes: int = NEAR_BYTES,
) -> DataFrame | Weights:
    """Weights after ``epoch`` (from 1), going on from those of the epoch before (None: all zero).

    ``rows`` are the texts (id, class_id, ...) to train on, :class:`Terms` for several epochs. From a written
    table of :func:`word_weights` and a table (token, w) they are encoded for this epoch, and the weights become a table again.
    """
    if k > MAX_CLASSES:
        raise ValueError(f"{k} classes, at most {MAX_CLASSES}")
    if not isinstance(rows, Terms):
        terms = encode(rows, weights=weights)
        placed = None if weights is None else _placed(weights, terms, k, max_bytes)
        return run_epoch(terms, placed, k, epoch, schedule, max_bytes).table(terms)
    if weights is None:
        weights = Weights(np.zeros((k, _cells(rows.size, k, max_bytes) + 1)))
    for b in range(schedule.batches):
        done = (epoch - 1) * schedule.batches + b + 1
        batch = replace(rows, rows=rows.rows.where(batch_of("id", epoch, schedule) == b))
        weights = step(batch, weights, k, schedule.rate_at(done), schedule.l2)
    return weights
