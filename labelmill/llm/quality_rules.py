"""Quality rules: simple counts of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hashed word uni- and bigrams (A-Z lower-cased) are counted:
one over the whole corpus, one over trusted documents, all that are labelled good and not toxic. A document's score is its mean log ratio per n-gram, so length does not count;
it is kept when the base rules hold and the score reaches a threshold. The prior is a share of the
trusted n-grams, so their number does not bound the scores. ``judge_by_labels`` leaves a fifth of
the trusted documents out of the counts; their scores set the threshold: the ``QUANTILE`` of them,
less ``MARGIN`` times its distance to their median, which does not fall as they become more.

Cases: a null or empty text has no words and fails the base rules; a document without n-grams
scores 0; without any trusted document all scores are 0, and without one left out no score
rejects; repeated rows are judged each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.arrays import chunks, gram_starts, mix, per_text, range_hashes, select_text, text_bytes, word_bounds
from labelmill.operators.tokens import with_dense_ids
from labelmill.scratch import lookup_join, materialize

BUCKETS = 1 << 16
PRIOR_SHARE = 0.3
THRESHOLD = -0.1
HELD_OUT_FOLDS = 5
QUANTILE = 0.05
MARGIN = 1.5
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, llr double, kept boolean"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every uni- and bigram."""
    words = range_hashes(_LOWER[data], starts, ends)
    at, doc = gram_starts(first, 2)
    pairs = mix(words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + 1])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = np.concatenate((words, pairs)) % np.uint64(BUCKETS)
    return grams.astype(np.int64), np.concatenate((owner, doc))


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words in windows of ``window`` words that occur twice or more in it."""
    at, doc = gram_starts(first, window)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        keys = mix(range_hashes(hashes, at, at + window) + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + window, -1)
    return per_text(np.cumsum(covered)[:-1] > 0, first)


def repeated_lines(text: bytes) -> int:
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    return repeated


def gram_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of the trusted ones; one row per bucket used.

    ``trusted`` (doc_id) is sent to every task if it is small, else joined.
    """
    marks = trusted.select("doc_id").distinct().withColumn("target", F.lit(True))
    marked = lookup_join(select_text(docs, id_col, text_col), marks, "doc_id", "text").select("text", "target")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in chunks(batches):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, first = word_bounds(data, offsets)
            grams, doc = buckets(data, starts, ends, first)
            raw += np.bincount(grams, minlength=BUCKETS)
            is_target = np.asarray(part.column("target").fill_null(False), bool)
            target += np.bincount(grams[is_target[doc]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(used), "raw": pa.array(raw[used]), "target": pa.array(target[used])}
        )

    counted = marked.mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): all rows labelled good and not toxic, each once."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")
    return good.where("doc_id IS NOT NULL").distinct()


def log_ratios(counts: DataFrame, prior: float | None = None) -> np.ndarray:
    """Log of target over raw probability of each bucket.

    The target has a prior of ``prior`` n-grams (``PRIOR_SHARE`` of its own unless given) spread like
    the raw corpus, so no n-gram's ratio is infinite, and without a sample all ratios are 0.
    """
    table = counts.toPandas()  # a row per bucket at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"]] = table["raw"]
    target[table["bucket"]] = table["target"]
    share = raw / max(raw.sum(), 1)
    if not target.sum():
        return np.zeros(BUCKETS)
    prior = PRIOR_SHARE * target.sum() if prior is None else prior
    over = np.divide(target, share, out=np.zeros(BUCKETS), where=share > 0)
    return np.log((over + prior) / (target.sum() + prior))


def judge(
    docs: DataFrame,
    ratios: np.ndarray,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, score and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, first = word_bounds(data, offsets)
            n = np.diff(first)
            grams, doc = buckets(data, starts, ends, first)
            n_grams = np.bincount(doc, minlength=len(n))
            llr = np.bincount(doc, shared.value[grams], minlength=len(n)) / np.maximum(n_grams, 1)
            repeats = repeated_words(range_hashes(data, starts, ends), first)
            solid = np.zeros(len(data) + 1, np.int8)
            solid[starts] += 1
            solid[ends] -= 1
            in_word = np.cumsum(solid, dtype=np.int8)[:-1] > 0
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(n),
                    "word_chars": pa.array(per_text(in_word & ((data & 0xC0) != 0x80), offsets)),
                    "n_symbols": pa.array(per_text(_SYMBOL[data], offsets)),
                    "n_dup_lines": pa.array(
                        [repeated_lines(t) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.int64()
                    ),
                    "n_repeat_words": pa.array(repeats),
                    "base_failed": pa.array(failed),
                    "llr": pa.array(llr),
                    "kept": pa.array(~failed & (llr >= threshold)),
                }
            )

    return select_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles of a column without nulls, between the two nearest values in a line; empty without rows.

    The values are ranked in range partitions, so no task holds them all.
    """
    ranked = with_dense_ids(df.select(value), [value], "_place", kind="bigint")
    n = ranked.count()
    if not n:
        return []
    at = [(n - 1) * share for share in shares]
    places = {int(f(x)) for x in at for f in (np.floor, np.ceil)}
    found = {r["_place"]: r[value] for r in ranked.where(F.col("_place").isin(list(places))).collect()}
    low, high = ([found[int(f(x))] for x in at] for f in (np.floor, np.ceil))
    return [a if a == b else (np.ceil(x) - x) * a + (x - np.floor(x)) * b for x, a, b in zip(at, low, high)]


def held_out_threshold(scored: DataFrame, held: DataFrame) -> float:
    """The threshold from the scores (of ``judge``) of ``held`` (doc_id), trusted documents that were not counted."""
    held = held.select("doc_id").distinct().withColumn("held", F.lit(True))
    some = lookup_join(scored.where("NOT base_failed").select("doc_id", "llr"), held, "doc_id", "llr", "inner")
    found = quantiles(some, "llr", (QUANTILE, 0.5))
    return found[0] - MARGIN * (found[1] - found[0]) - 1e-9 if found else -np.inf


def judge_by_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, score and verdict of every document by the ratios and the threshold that ``labels`` give."""
    trusted = materialize(trusted_ids(labels), "trusted")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_FOLDS == 0
    ratios = log_ratios(gram_counts(docs, trusted.where(~held), id_col, text_col))
    scored = materialize(judge(docs, ratios, -np.inf, id_col, text_col), "scored")
    threshold = held_out_threshold(scored, trusted.where(held))
    return scored.withColumn("kept", F.col("kept") & (F.col("llr") >= float(threshold)))
