"""Multinomial naive Bayes as DataFrame aggregates.

A model is a token table with one array of k log-likelihoods per token, plus k log-priors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators.labels import Classes, class_sizes
from labelmill.operators.tokens import word_rows
from labelmill.scratch import BROADCAST_BYTES, largest, materialize, row_bytes, shuffled_lookup, with_row_key


@dataclass(frozen=True)
class NaiveBayesModel:
    classes: Classes
    log_priors: tuple[float, ...]
    tokens: DataFrame  # token string, weights array<double>
    bytes: int  # estimate of the token table as a broadcast table


def token_class_counts(train: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(token, counts): occurrences of the token per class id. Tasks sum their own words first."""
    per_class = [F.expr(f"count_if(class_id = {c}) AS c{c}") for c in range(k)]
    counted = word_rows(train, ["class_id"], text).where("token <> ''").groupBy("token").agg(*per_class)
    return counted.select("token", F.array(*[f"c{c}" for c in range(k)]).alias("counts"))


def fit_from_counts(
    counts: DataFrame, sizes: dict[int, int], classes: Classes, smoothing: float | Sequence[float] = 1.0
) -> NaiveBayesModel:
    """Model from a (materialized) count table; several smoothings can share one table.

    ``sizes`` are the training texts per class id. Of several smoothings the models stand side by side: priors,
    weights and the scores made of them are those of the first, then those of the second, and so on.
    """
    k, smoothings = len(classes), [float(x) for x in (smoothing if isinstance(smoothing, Sequence) else [smoothing])]
    totals = counts.agg(
        F.count("*").alias("v"),
        F.coalesce(F.sum(row_bytes(counts.schema)), F.lit(0)).alias("bytes"),
        *[F.expr(f"coalesce(sum(get(counts, {c})), 0) AS t{c}") for c in range(k)],
    ).first()
    weights = ", ".join(
        f"ln((get(counts, {c}) + {x!r}D) / {totals[f't{c}'] + x * totals['v']!r}D)"
        for x in smoothings
        for c in range(k)
    )
    n = sum(sizes.values())
    priors = tuple(log(sizes[c] / n) if sizes.get(c) else float("-inf") for c in range(k))
    tokens = counts.selectExpr("token", f"array({weights}) AS weights")
    return NaiveBayesModel(classes, priors * len(smoothings), tokens, totals["bytes"] * len(smoothings))


def fit(
    train: DataFrame,
    classes: Classes,
    text: str = "text",
    smoothing: float = 1.0,
    sizes: dict[int, int] | None = None,
) -> NaiveBayesModel:
    """Fit on ``train(text, class_id)``, add-``smoothing`` over the training vocabulary.

    ``sizes`` are the texts per class id; they are counted if not given.
    """
    counts = materialize(token_class_counts(train, len(classes), text), "token-counts")
    sizes = class_sizes(train, "class_id") if sizes is None else sizes
    return fit_from_counts(counts, sizes, classes, smoothing)


def class_scores(
    df: DataFrame,
    model: NaiveBayesModel,
    keep: Sequence[str],
    text: str = "text",
    max_bytes: int = BROADCAST_BYTES,
    row: str | None = None,
) -> DataFrame:
    """(*keep, scores): log prior plus summed log-likelihoods of the known words, per class and row of ``df``.

    ``row`` names a column of ``keep`` that is known to be unique; without one the rows are
    written first and told apart by their place, so equal ids are never merged.
    A model that fits is broadcast: words meet it where the text was read and only k sums
    per text are shuffled. Of a larger one the likeliest words are, and only the other words of the texts,
    counted per text, are shuffled to the rest of it.
    """
    k = len(model.log_priors)
    keep = list(keep)
    if row is None:
        row, df = "_row", with_row_key(df.select(*keep, F.col(text).alias(text)) if text not in keep else df.select(*keep))
    carried = [c for c in keep if c != row]
    rows = word_rows(df, [row], text)
    if model.bytes <= max_bytes:
        summed = _summed(rows.join(F.broadcast(model.tokens), "token", "left"), F.lit(1), k, row)
    else:
        head, tail = likeliest(model, max_bytes)
        near = _summed(rows.join(F.broadcast(head), "token", "left"), F.lit(1), k, row)
        others = rows.where("token <> ''").join(F.broadcast(head.select("token")), "token", "left_anti")
        others = materialize(others.groupBy(row, "token").agg(F.count("*").alias("tf")), "other-words")
        far = _summed(shuffled_lookup(others, tail, "token", row, "inner"), F.col("tf"), k, row)
        summed = near.union(far).groupBy(row).agg(*[F.sum(f"_s{c}").alias(f"_s{c}") for c in range(k)])
    if carried:  # put to the sums, not to the words: words with a text beside them could only be summed by sorting
        beside = df.groupBy(F.col(row).alias("_of")).agg(*[F.first(c).alias(c) for c in carried])
        summed = summed.join(beside, F.col(row).eqNullSafe(F.col("_of")))
    scores = ", ".join(f"coalesce(_s{c}, 0D) + double('{p!r}')" for c, p in enumerate(model.log_priors))
    return summed.select(*keep, F.expr(f"array({scores})").alias("scores"))


def _summed(joined: DataFrame, tf: Column, k: int, row: str) -> DataFrame:
    """(row, _s0, _s1, ...): weights of the words summed per row and class."""
    return joined.groupBy(row).agg(*[F.sum(F.get("weights", F.lit(c)) * tf).alias(f"_s{c}") for c in range(k)])


def likeliest(model: NaiveBayesModel, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The token table in two: the words of the greatest weight in any class, about ``max_bytes`` of them, and the rest.

    These few are most words of a text. The bound is an approximate quantile; it only places rows.
    """
    return largest(model.tokens, F.array_max("weights"), max_bytes / max(model.bytes, 1))
