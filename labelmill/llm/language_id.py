"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the share of byte n-grams (lengths 1 to 3, a blended spectrum) that
both contain, |x and y| / sqrt(|x| |y|); how often an n-gram occurs does not count. Texts of a
bounded labelled sample are mapped by landmarks, and one ridge regression per language learns
+1 against -1. A batch is scored by one matrix product: presence rows times (landmarks times
weights), which is the kernel against all landmarks times the weights, multiplied in that order.

Cases: a text that is null, empty or without a letter is ``und`` with score 0; labels that are
null are not learned; without any label everything is ``und``; ties go to the smaller language;
repeated rows are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from labelmill.llm.arrays import CHUNK_BYTES, chunks, select_text, text_bytes
from labelmill.scratch import materialize

FEATURES = 1 << 15
GRAM_LENGTHS = (1, 2, 3)
#: Bound of the labelled sample: documents per language, of which so many are landmarks.
SAMPLE_A_CLASS = 400
LANDMARKS_A_CLASS = 64
#: Bound of the whole sample, and so of the languages; with many languages each has fewer documents.
MAX_SAMPLE = 4000
RIDGE = 1e-2
#: Different n-grams a text needs for its language to be doubted, and the score of a text that shares none with the model.
EVIDENCE = 200
NO_EVIDENCE = 0.5
UNKNOWN = "und"
HELD_OUT_FOLDS = 5
ROWS_A_PRODUCT = 128

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` flags per text: which hashed n-grams of its letters it has."""
    flags = np.zeros((len(offsets) - 1, FEATURES), bool)
    for lo in range(0, len(data), CHUNK_BYTES):
        hi = min(len(data), lo + CHUNK_BYTES)
        wide = min(len(data), hi + GRAM_LENGTHS[-1] - 1)
        codes = _LETTER[data[lo:wide]].astype(np.uint32)
        doc = np.searchsorted(offsets, np.arange(lo, wide), "right") - 1
        for k in GRAM_LENGTHS:
            n = min(hi - lo, wide - lo - k + 1)
            if n <= 0:
                continue
            gram = np.full(n, k, np.uint32)
            for j in range(k):
                gram = gram << np.uint32(8) | codes[j : j + n]
            slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
            whole = doc[:n] == doc[k - 1 : k - 1 + n]
            flags[doc[:n][whole], slot[whole]] = True
    return flags


def has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    ascii_letters = np.add.reduceat(np.append(_ASCII_LETTER[data], False).astype(np.int64), offsets[:-1])
    out = (ascii_letters > 0) & (np.diff(offsets) > 0)
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return out


def training_sample(docs: DataFrame, per_class: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bits): packed presence flags of at most ``per_class`` labelled documents a language.

    A hash of the id picks them: first by a share known from the counts, then by rank.
    """
    labelled = select_text(docs, id_col, text_col, F.col(f"`{lang_col}`").cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.xxhash64("doc_id")
    sizes = materialize(labelled.groupBy("lang").count(), "language_sizes")
    n = sizes.count()
    if n > MAX_SAMPLE:
        raise ValueError(f"{n} languages, at most {MAX_SAMPLE}")
    per_class = max(1, min(per_class, MAX_SAMPLE // max(n, 1)))
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(3.0 * per_class) / F.col("count")).alias("share"))
    near = labelled.join(F.broadcast(shares), "lang")  # MAX_SAMPLE rows at most
    near = near.where(place.cast("double") / F.lit(2.0**64) + 0.5 <= F.col("share")).drop("share")
    ranked = near.withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text")))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, max_rows=ROWS_A_PRODUCT):
            data, offsets = text_bytes(part.column("text"))
            bits = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": part.column("lang"),
                    "nth": part.column("nth"),
                    "bits": pa.array([b.tobytes() for b in bits], pa.binary()),
                }
            )

    chosen = ranked.where(F.col("nth") <= per_class).select("lang", "nth", "text")
    return chosen.mapInArrow(pack, "lang string, nth int, bits binary")


def fit(
    docs: DataFrame,
    per_class: int = SAMPLE_A_CLASS,
    landmarks: int = LANDMARKS_A_CLASS,
    ridge: float = RIDGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """The model of the non-held-out documents with a label."""
    sample = training_sample(docs, per_class, id_col, text_col, lang_col).toPandas()
    if sample.empty:
        return Model([], np.zeros((FEATURES, 0), np.float32))
    sample = sample.sort_values(["lang", "nth"], ignore_index=True)
    languages = sorted(sample["lang"].unique())
    rows = np.unpackbits(np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1), axis=1)
    rows = rows.astype(np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    marks = rows[(sample["nth"] <= landmarks).to_numpy()]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    strong = values > 1e-6 * max(values.max(), 1e-300)
    whiten = vectors[:, strong] / np.sqrt(values[strong])
    mapped = (rows @ marks.T).astype(np.float64) @ whiten
    wanted = np.where(sample["lang"].to_numpy()[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    sizes = wanted.clip(0).sum(axis=0)
    balance = (1 / sizes)[wanted.argmax(axis=1)][:, None]  # each language weighs the same
    gram = mapped.T @ (mapped * balance) + ridge * np.eye(mapped.shape[1])
    weights = whiten @ np.linalg.solve(gram, mapped.T @ (wanted * balance))
    return Model(languages, (marks.T @ weights.astype(np.float32)))


def classify(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, different n-grams) of each text; one past the last index is ``und``."""
    languages, weights = model.languages, model.weights
    data, offsets = text_bytes(texts)
    known = has_letter(data, offsets, texts) & (len(languages) > 0)
    best, score, grams = np.full(len(known), len(languages)), np.zeros(len(known)), np.zeros(len(known), np.int64)
    if known.any():
        flags = presence(data, offsets)
        grams = flags.sum(axis=1)
        raw = (flags.astype(np.float32) @ weights).astype(np.float64)
        raw /= np.sqrt(np.maximum(grams, 1))[:, None]
        best = np.where(known, raw.argmax(axis=1), best)
        score = np.where(known, np.clip((raw.max(axis=1) + 1) / 2, 0, 1), 0.0)
    return best, score, grams


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for part in chunks(batches, max_rows=ROWS_A_PRODUCT):
            best, score, _ = classify(part.column("text"), shared.value)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "lang_pred": pa.array(names[best].tolist(), pa.string()),
                    "score": pa.array(score),
                }
            )

    rows = select_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(run, SCHEMA)


def rejected_rows(keyed: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row_id) of the rows of ``keyed`` without a letter, or in none of the labelled languages.

    The model is :func:`fit` on ``keyed``. A text that shares nothing with the labelled ones scores 0.5.
    The floor is halfway between that and the lowest score of the held-out rows with a label, which the
    model has not seen; where that is no higher than 0.5 there is no floor. Only texts with ``EVIDENCE``
    different n-grams set and meet the floor: a shorter text says too little to be rejected. Without
    labels only rows without a letter are rejected.
    """
    model = fit(keyed, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = keyed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, max_rows=ROWS_A_PRODUCT):
            _, score, grams = classify(part.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("row_id"), part.column("lettered"), part.column("fold"), pa.array(score), pa.array(grams)],
                ["row_id", "lettered", "fold", "score", "grams"],
            )

    fold = F.col(f"`{lang_col}`").isNotNull() & held_out(F.col(f"`{id_col}`"))
    rows = select_text(keyed, id_col, text_col, F.col(f"`{row_col}`").alias("row_id"), fold.alias("fold"))
    rows = rows.select("row_id", F.col("text").rlike(r"\p{L}").alias("lettered"), "fold", "text")
    scored = materialize(rows.mapInArrow(run, "row_id string, lettered boolean, fold boolean, score double, grams long"), "language_scores")
    enough = F.col("lettered") & (F.col("grams") >= EVIDENCE)
    lowest = scored.where(F.col("fold") & enough).agg(F.min("score")).first()[0]
    off = F.lit(False)
    if model.languages and lowest is not None and lowest > NO_EVIDENCE:
        off = enough & (F.col("score") < (NO_EVIDENCE + lowest) / 2)
    return scored.where(~F.col("lettered") | off).select("row_id")
