"""Shared inputs of the registered queries, in Spark and as SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.sources.samples import row_order, spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """``documents`` as samples (id, ord, text, label)."""
    return _as_samples(table(spark, sf_dir, "documents"), label)


def spread_samples(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """The same for queries that work on the words right after the scan."""
    return _as_samples(spread(table(spark, sf_dir, "documents")), label)


def _as_samples(documents: DataFrame, label: str) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"),
        row_order(F.col("doc_id")).alias("ord"),
        "text",
        F.col(label).alias("label"),
    )


def joined(ids: str):
    """An array column as one comma-separated string."""
    return F.concat_ws(",", F.transform(ids, lambda x: x.cast("string")))


def split_sql(source: str, suffix: str = "", seed: int = 42) -> str:
    """CTEs ``classes``, ``quotas`` and ``folds`` (with ``suffix``) for the 80/20 split of a CTE."""
    return f"""
classes{suffix} AS (
  SELECT label, n, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_id
  FROM (SELECT label, count(*) AS n FROM {source} GROUP BY label)),
totals{suffix} AS (
  SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) - (CAST(sum(n) AS BIGINT) * 20 + 99) // 100 AS n_train
  FROM classes{suffix}),
shares{suffix} AS (
  SELECT c.label, c.n, c.class_id, c.n * t.n_train // t.n AS base, c.n * t.n_train % t.n AS rem, t.n_train
  FROM classes{suffix} c, totals{suffix} t),
quotas{suffix} AS (
  SELECT label, n, class_id,
         base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                          <= n_train - CAST(sum(base) OVER () AS BIGINT) THEN 1 ELSE 0 END AS n_train
  FROM shares{suffix}),
folds{suffix} AS (
  SELECT c.id, c.text, c.label, q.class_id,
         CASE WHEN row_number() OVER (PARTITION BY c.label
                     ORDER BY md5('{seed}:' || CAST(c.id AS VARCHAR)), c.id) <= q.n_train
              THEN 'train' ELSE 'test' END AS fold
  FROM {source} c JOIN quotas{suffix} q ON c.label = q.label)"""


def corpus_sql(label: str = "lang", validation: bool = False) -> str:
    """CTE ``corpus``, the distinct texts of one label column, and its folds.

    With ``validation`` the folds are those of the train fold split once more.
    """
    corpus = f"""
corpus AS (
  SELECT id, text, label FROM (
    SELECT doc_id AS id, text, {label} AS label,
           row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
    FROM documents WHERE text IS NOT NULL AND {label} IS NOT NULL) WHERE rn = 1),"""
    if not validation:
        return corpus + split_sql("corpus")
    return f"""{corpus}{split_sql("corpus", "_outer")},
train_corpus AS (SELECT id, text, label FROM folds_outer WHERE fold = 'train'),
{split_sql("train_corpus", seed=43)}"""


WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"


TEST_FOLD = "SELECT id, text, label FROM folds WHERE fold = 'test'"


def nb_sql(
    label: str = "lang", scored: str = TEST_FOLD, smoothing: float = 1.0, validation: bool = False
) -> str:
    """CTEs up to ``probs(id, label, class_id, class_name, p)`` and ``best`` for the ``scored`` rows."""
    return f"""{corpus_sql(label, validation)},
scored AS ({scored}),
train_words AS (SELECT label, unnest({WORDS}) AS token FROM folds WHERE fold = 'train'),
token_counts AS (SELECT token, label, count(*) AS n FROM train_words GROUP BY token, label),
label_totals AS (SELECT label, CAST(sum(n) AS DOUBLE) AS total FROM token_counts GROUP BY label),
vocab AS (SELECT DISTINCT token FROM token_counts),
likelihoods AS (
  SELECT v.token, t.label, ln((coalesce(c.n, 0) + {smoothing}E0) / (t.total + {smoothing}E0 * (SELECT count(*) FROM vocab))) AS ll
  FROM vocab v CROSS JOIN label_totals t
  LEFT JOIN token_counts c ON c.token = v.token AND c.label = t.label),
priors AS (
  SELECT label, ln(count(*) / CAST((SELECT count(*) FROM folds WHERE fold = 'train') AS DOUBLE)) AS lp
  FROM folds WHERE fold = 'train' GROUP BY label),
test_words AS (
  SELECT id, token, count(*) AS tf
  FROM (SELECT id, unnest({WORDS}) AS token FROM scored) GROUP BY id, token),
sums AS (
  SELECT w.id, l.label, sum(w.tf * l.ll) AS s
  FROM test_words w JOIN likelihoods l ON w.token = l.token GROUP BY w.id, l.label),
scores AS (
  SELECT f.id, f.label, q.class_id, q.label AS class_name, p.lp + coalesce(s.s, 0) AS score
  FROM scored f CROSS JOIN quotas q
  JOIN priors p ON p.label = q.label
  LEFT JOIN sums s ON s.id = f.id AND s.label = q.label),
shifted AS (SELECT *, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM scores),
probs AS (SELECT id, label, class_id, class_name, e / sum(e) OVER (PARTITION BY id) AS p FROM shifted),
best AS (
  SELECT id, label, class_id, class_name AS prediction, round_even(p * 100, 2) AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class_id) AS rn FROM probs)
  WHERE rn = 1)"""
