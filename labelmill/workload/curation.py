"""Registered queries: sources, curation, labels, splits."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import functions as F

from labelmill.functions.text import WHITESPACE, strip
from labelmill.operators import curate, labels, sampling
from labelmill.plans import curation as plan
from labelmill.plans.training import prepare
from labelmill.scratch import materialize, new_path
from labelmill.sources import samples as src
from labelmill.workload.base import corpus_sql, samples, table

LANGUAGES = (("de", "German"), ("en", "English"), ("es", "Spanish"), ("fr", "French"))


def three_sources(spark, sf):
    """Documents first, then conversation turns and benchmark passages, each under one tag."""
    docs = samples(spark, sf).withColumn("key", F.col("id").cast("string")).drop("id")
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("key"),
        src.row_order(F.col("turn"), F.col("conv_id")).alias("ord"),
        "text",
        "role",
    )
    passages = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("key"), src.row_order(F.col("item_id")).alias("ord"), "text"
    )
    return [docs, src.tag_source(turns, "conversation"), src.tag_source(passages, "benchmark")]


THREE_SOURCES = """
united AS (
  SELECT 0 AS source_rank, CAST(doc_id AS VARCHAR) AS key, text, lang AS label, CAST(NULL AS VARCHAR) AS role,
         0 AS major, doc_id AS minor FROM documents
  UNION ALL
  SELECT 1, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), text, 'conversation', role, conv_id, turn
  FROM conversations
  UNION ALL
  SELECT 2, CAST(item_id AS VARCHAR), text, 'benchmark', NULL, 0, item_id FROM benchmark),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, major, minor) AS rn FROM united)
  WHERE rn = 1)"""


def row_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n_rows"))


def class_counts(spark, sf):
    return curate.class_counts(samples(spark, sf)).orderBy("label")


def min_class_size(spark, sf):
    return curate.min_class_size(samples(spark, sf, "source"))


def class_list(spark, sf):
    return labels.fit_classes(samples(spark, sf, "source")).table(spark)


def dedup_keep_first(spark, sf):
    return curate.dedup_keep_first(samples(spark, sf), priority=["ord"]).select("id", "text", "label")


def duplicates_removed(spark, sf):
    return curate.duplicates_removed(samples(spark, sf))


def dedup_with_counts(spark, sf):
    """The counts that de-duplication has made on its way, next to what is left."""
    kept, counts = curate.dedup_with_counts(samples(spark, sf), priority=["ord"])
    return kept.agg(F.count("*").alias("rows_left")).select("rows_left", *[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])


def union_sources(spark, sf):
    return curate.union_sources(three_sources(spark, sf)).select("source_rank", "key", "text", "label", "role")


def union_positions(spark, sf):
    """The union renumbered: source after source, each in its own order."""
    united = curate.union_sources(three_sources(spark, sf))
    return curate.with_positions(united).select("position", "source_rank", "key", "text")


def union_dedup(spark, sf):
    united = curate.union_sources(three_sources(spark, sf))
    return curate.dedup_keep_first(united).select("source_rank", "key", "text", "label", "role")


def missing_source(spark, sf):
    absent = src.read_samples(spark, new_path(spark, "absent") + ".csv", missing_ok=True)
    return curate.class_counts(curate.union_sources([absent, samples(spark, sf).drop("id")]))


def _lines(spark, sf):
    covered = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return covered.select("doc_id", "quality", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """
lines AS (
  SELECT doc_id, quality, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no
  FROM (SELECT d.doc_id, l.quality, string_split(d.text, chr(10)) AS parts
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""
TRIM_CHARS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def null_blank_filter(spark, sf):
    kept = curate.clean(_lines(spark, sf), "line", "quality")
    return curate.drop_blank(kept, "line").select("doc_id", "line_no", "line", "quality")


def strip_lower(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", F.lower(strip(F.col("line"))).alias("line"))


def label_override(spark, sf):
    flagged = table(spark, sf, "labels").where("toxic = 1")
    overrides = flagged.select(F.col("doc_id").alias("id"), F.lit("flagged").alias("label"))
    return curate.override_labels(samples(spark, sf), overrides, "id", on="id").select("id", "label")


def label_override_by_text(spark, sf):
    """The texts of toxic documents, relabelled wherever they occur."""
    flagged = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    overrides = samples(spark, sf).join(flagged, "id", "left_semi").select("text", F.lit("flagged").alias("label"))
    return curate.override_labels(samples(spark, sf), overrides, "id").select("id", "label")


def corpus_profile(spark, sf):
    profile = curate.profile(samples(spark, sf))
    return labels.describe(profile, LANGUAGES).select("label", "description", "example", "samples")


def balanced_sample(spark, sf):
    distinct = materialize(curate.dedup_keep_first(samples(spark, sf), priority=["ord"]))
    return sampling.balance(distinct).select("id", "label", "text").sort("label", "id")


def curated_corpus(spark, sf):
    return plan.curated([s.drop("key", "role") for s in three_sources(spark, sf)]).select("id", "label", "text")


def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    src.write_samples(samples(spark, sf).select("text", "label"), path)
    return src.read_samples(spark, path).select("text", "label")


def curate_in_place(spark, sf):
    path = new_path(spark, "corpus")
    src.write_samples(samples(spark, sf).select("text", "label"), path)
    extra = src.tag_source(table(spark, sf, "benchmark"), "benchmark").select(
        "text", "label", src.row_order(F.col("item_id")).alias("ord")
    )
    plan.curate_to([src.read_samples(spark, path), extra], path)
    return curate.class_counts(src.read_samples(spark, path)).orderBy("label")


def rewrite_in_place(spark, sf):
    """A corpus replaced by a change of itself; a second change that fails halfway then changes nothing."""
    path = new_path(spark, "corpus")
    src.write_samples(samples(spark, sf).select("text", "label"), path)
    src.write_samples(src.read_samples(spark, path).select("text", F.upper("label").alias("label")), path)
    broken = F.when(F.col("label") == "EN", F.raise_error(F.lit("a failing write")).cast("string")).otherwise("lost")
    with suppress(Exception):
        src.write_samples(src.read_samples(spark, path).select("text", broken.alias("label")), path)
    return src.read_samples(spark, path).select("text", "label")


def label_encode(spark, sf):
    docs = samples(spark, sf, "source")
    return labels.encode(docs, labels.fit_classes(docs)).select("id", "label", "class_id")


def label_decode(spark, sf):
    docs = samples(spark, sf, "source")
    classes = labels.fit_classes(docs)
    ids = labels.encode(docs, classes).select("id", "class_id")
    return labels.decode(ids, classes).select("id", "class_id", "class_name")


def split_quota(spark, sf):
    distinct = curate.dedup_keep_first(samples(spark, sf, "source"), priority=["ord"])
    sizes = labels.class_sizes(distinct)
    quotas = sampling.split_quotas(sizes)
    return spark.createDataFrame(
        [(k, q, sizes[k] - q) for k, q in quotas.items()], "label string, n_train bigint, n_test bigint"
    )


def stratified_split(spark, sf):
    return prepare(samples(spark, sf, "source")).corpus.select("id", "label", "class_id", "fold")


QUERIES = {
    "row_count": (row_count, "SELECT count(*) AS n_rows FROM documents"),
    "class_counts": (
        class_counts,
        "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    ),
    "min_class_size": (
        min_class_size,
        "SELECT min(n) AS min_class_size FROM (SELECT count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)",
    ),
    "class_list": (
        class_list,
        """SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS class_id, source AS class_name
           FROM (SELECT DISTINCT source FROM documents)""",
    ),
    "dedup_keep_first": (dedup_keep_first, f"WITH {corpus_sql()} SELECT id, text, label FROM corpus"),
    "duplicates_removed": (
        duplicates_removed,
        """SELECT b AS rows_before, a AS rows_after, b - a AS removed
           FROM (SELECT count(*) AS b, count(DISTINCT text) + CASE WHEN count(*) > count(text) THEN 1 ELSE 0 END AS a
                 FROM documents)""",
    ),
    "dedup_with_counts": (
        dedup_with_counts,
        """SELECT a AS rows_left, b AS rows_before, a AS rows_after, b - a AS removed
           FROM (SELECT count(*) AS b, count(DISTINCT text) + CASE WHEN count(*) > count(text) THEN 1 ELSE 0 END AS a
                 FROM documents)""",
    ),
    "union_sources": (union_sources, f"WITH {THREE_SOURCES} SELECT source_rank, key, text, label, role FROM united"),
    "union_positions": (
        union_positions,
        f"""WITH {THREE_SOURCES} SELECT row_number() OVER (ORDER BY source_rank, major, minor) - 1 AS position,
                   source_rank, key, text FROM united""",
    ),
    "union_dedup": (union_dedup, f"WITH {THREE_SOURCES} SELECT source_rank, key, text, label, role FROM firsts"),
    "missing_source": (missing_source, "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang"),
    "null_blank_filter": (
        null_blank_filter,
        f"""WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, quality FROM lines
            WHERE line IS NOT NULL AND quality IS NOT NULL AND trim(line, {TRIM_CHARS}) <> ''""",
    ),
    "strip_lower": (
        strip_lower,
        f"WITH {LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, lower(trim(line, {TRIM_CHARS})) AS line FROM lines",
    ),
    "label_override": (
        label_override,
        """SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'flagged' ELSE d.lang END AS label
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "label_override_by_text": (
        label_override_by_text,
        """WITH flagged AS (
             SELECT DISTINCT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)
           SELECT d.doc_id AS id, CASE WHEN f.text IS NOT NULL THEN 'flagged' ELSE d.lang END AS label
           FROM documents d LEFT JOIN flagged f ON d.text = f.text""",
    ),
    "corpus_profile": (
        corpus_profile,
        """SELECT lang AS label,
                  CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English'
                            WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END AS description,
                  arg_min(text, doc_id) AS example, count(*) AS samples
           FROM documents GROUP BY lang""",
    ),
    "balanced_sample": (
        balanced_sample,
        f"""WITH {corpus_sql()} SELECT id, label, text FROM (
              SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rk FROM corpus)
            WHERE rk <= (SELECT min(n) FROM classes)""",
    ),
    "curated_corpus": (
        curated_corpus,
        f"""WITH {THREE_SOURCES},
            keyed AS (SELECT sha256(text) AS id, label, text FROM firsts)
            SELECT id, label, text FROM (
              SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rk FROM keyed)
            WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM firsts GROUP BY label))""",
    ),
    "csv_round_trip": (csv_round_trip, "SELECT text, lang AS label FROM documents"),
    "curate_in_place": (
        curate_in_place,
        """WITH u AS (SELECT text, lang AS label, 0 AS r, doc_id AS o FROM documents
                      UNION ALL SELECT text, 'benchmark', 1, item_id FROM benchmark),
           f AS (SELECT label, count(*) AS n FROM (
                   SELECT *, row_number() OVER (PARTITION BY text ORDER BY r, o) AS rn FROM u) WHERE rn = 1 GROUP BY label)
           SELECT label, (SELECT min(n) FROM f) AS n FROM f""",
    ),
    "rewrite_in_place": (rewrite_in_place, "SELECT text, upper(lang) AS label FROM documents"),
    "label_encode": (
        label_encode,
        "SELECT doc_id AS id, source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS class_id FROM documents",
    ),
    "label_decode": (
        label_decode,
        "SELECT doc_id AS id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS class_id, source AS class_name FROM documents",
    ),
    "split_quota": (split_quota, f"WITH {corpus_sql('source')} SELECT label, n_train, n - n_train AS n_test FROM quotas"),
    "stratified_split": (
        stratified_split, f"WITH {corpus_sql('source')} SELECT id, label, class_id, fold FROM folds",
    ),
}
