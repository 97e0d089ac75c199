"""Registered queries: words, vocabularies, ids, padding, sub-words."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from labelmill.functions.text import fold_marks, words, words_and_marks
from labelmill.operators import subwords as sub
from labelmill.operators import tokens
from labelmill.operators.encoder import SubwordEncoder
from labelmill.plans.training import prepare
from labelmill.scratch import materialize, new_path
from labelmill.sources.vocabulary import read_vocabulary, write_vocabulary
from labelmill.workload.base import WORDS, corpus_sql, joined, samples, spread_samples, table

MARKS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"


def word_split(spark, sf):
    docs = spread_samples(spark, sf).select("id", words(F.col("text")).alias("w"))
    return docs.select("id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"))


def word_split_marks(spark, sf):
    docs = spread_samples(spark, sf).select("id", words_and_marks(F.col("text")).alias("w"))
    return docs.select("id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


def vocabulary(spark, sf):
    return tokens.vocabulary(spread_samples(spark, sf)).select("token", "n", "doc_freq", "token_id")


VOCABULARY = f"""
word_rows AS (SELECT doc_id AS id, unnest({WORDS}) AS token FROM documents),
vocab AS (
  SELECT token, n, doc_freq, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id
  FROM (SELECT token, count(*) AS n, count(DISTINCT id) AS doc_freq FROM word_rows GROUP BY token))"""


def frequent_words(spark, sf):
    """The vocabulary's own filter: words of two or more documents."""
    return tokens.vocabulary(spread_samples(spark, sf), min_df=2).select("token", "n", "doc_freq", "token_id")


FREQUENT = """
  SELECT token, n, doc_freq, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id
  FROM vocab WHERE doc_freq >= 2"""


def encode_ids(spark, sf):
    """Whole texts, of any length."""
    docs = spread_samples(spark, sf)
    vocab = materialize(tokens.vocabulary(docs), "vocabulary")
    return tokens.encode_ids(docs, vocab).select("id", joined("input_ids").alias("input_ids"))


ENCODE = f"""
  SELECT d.id, '2,' || CASE WHEN d.id IS NULL THEN '' ELSE coalesce(t.ids || ',', '') END || '3' AS input_ids
  FROM (SELECT doc_id AS id FROM documents) d LEFT JOIN (
    SELECT id, string_agg(CAST(coalesce(token_id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids
    FROM (SELECT id, token, pos FROM (
            SELECT doc_id AS id, unnest({WORDS}) AS token,
                   generate_subscripts({WORDS}, 1) AS pos FROM documents)) w
    LEFT JOIN vocab v USING (token) GROUP BY id) t ON d.id = t.id"""


def pad_mask(spark, sf):
    """Per fold: ids cut at 64 positions as the encoder does, padded, masked, with their class."""
    p = prepare(samples(spark, sf))
    vocab = materialize(tokens.vocabulary(p.fold("train")), "vocabulary")
    encoded = tokens.encode_ids(p.corpus, vocab, keep=["class_id", "fold"], max_length=tokens.MAX_LENGTH)
    padded = tokens.pad_and_mask(materialize(encoded, "encoded"), max_length=tokens.MAX_LENGTH, by="fold")
    return padded.select(
        "id",
        "fold",
        "class_id",
        joined("input_ids").alias("input_ids"),
        joined("attention_mask").alias("attention_mask"),
    )


PAD_MASK = f"""
WITH {corpus_sql()},
split AS (SELECT id, fold, class_id, {WORDS} AS words FROM folds),
train_rows AS (SELECT id, unnest(words) AS token FROM split WHERE fold = 'train'),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id
  FROM (SELECT token, count(*) AS n FROM train_rows GROUP BY token)),
kept AS (SELECT id, fold, class_id, list_slice(words, 1, 62) AS words FROM split),
rows AS (SELECT id, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM kept),
ids AS (
  SELECT id, string_agg(CAST(coalesce(token_id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids
  FROM rows LEFT JOIN vocab USING (token) GROUP BY id),
sized AS (
  SELECT k.id, k.fold, k.class_id, '2,' || coalesce(i.ids || ',', '') || '3' AS ids, len(k.words) + 2 AS size,
         max(len(k.words) + 2) OVER (PARTITION BY k.fold) AS longest
  FROM kept k LEFT JOIN ids i ON k.id = i.id)
SELECT id, fold, class_id, ids || repeat(',0', longest - size) AS input_ids,
       '1' || repeat(',1', size - 1) || repeat(',0', longest - size) AS attention_mask
FROM sized"""


def _pieces(spark, sf):
    """Pieces taken from the words of ``conversations``, each usable at the start and inside."""
    turns = materialize(tokens.token_stats(table(spark, sf, "conversations")))
    starts = turns.select(F.col("token").alias("piece"))
    inside = turns.select(F.concat(F.lit(sub.CONTINUATION), "token").alias("piece"))
    pieces = tokens.with_dense_ids(starts.union(inside), [F.asc("piece")], "token_id", start=4)
    return materialize(pieces, "pieces")


def subword_pieces(spark, sf):
    """Every distinct word of the documents that the pieces can spell."""
    rows = spread_samples(spark, sf).select(F.explode(words(F.col("text"))).alias("word"))
    spelled = sub.segment_words(rows.distinct(), _pieces(spark, sf))
    return spelled.select("word", F.array_join("pieces", " ").alias("pieces"))


def subword_ids(spark, sf):
    """Whole documents as piece ids."""
    found = sub.subwords(spread_samples(spark, sf), _pieces(spark, sf))
    return found.select("id", joined("input_ids").alias("input_ids"))


SUBWORDS = rf"""
WITH RECURSIVE
turn_words AS (SELECT unnest({WORDS}) AS token FROM conversations),
kept AS (SELECT DISTINCT token FROM turn_words),
pieces AS (SELECT token AS piece FROM kept UNION ALL SELECT '##' || token FROM kept),
vocab AS (SELECT piece, row_number() OVER (ORDER BY piece) + 3 AS token_id FROM pieces),
occurrences AS (
  SELECT doc_id AS id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM documents),
distinct_words AS (SELECT DISTINCT word FROM occurrences),
starts AS (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM distinct_words),
spans AS (SELECT word, start, unnest(range(1, length(word) - start + 2)) AS len FROM starts),
hits AS (
  SELECT s.word, s.start, s.len, v.piece, v.token_id,
         row_number() OVER (PARTITION BY s.word, s.start ORDER BY s.len DESC) AS rn
  FROM spans s JOIN vocab v
    ON v.piece = CASE WHEN s.start > 1 THEN '##' ELSE '' END || substring(s.word, s.start, s.len)),
walk AS (
  SELECT word, CAST(1 AS BIGINT) AS reached, CAST('' AS VARCHAR) AS pieces, CAST('' AS VARCHAR) AS ids FROM distinct_words
  UNION ALL
  SELECT w.word, w.reached + h.len, w.pieces || ' ' || h.piece, w.ids || ',' || CAST(h.token_id AS VARCHAR)
  FROM walk w JOIN hits h ON h.word = w.word AND h.start = w.reached AND h.rn = 1),
spelled AS (SELECT word, substring(pieces, 2) AS pieces, substring(ids, 2) AS ids FROM walk WHERE reached = length(word) + 1)"""

SUBWORD_IDS = f"""{SUBWORDS},
texts AS (
  SELECT o.id, string_agg(coalesce(s.ids, '1'), ',' ORDER BY o.pos) AS input_ids
  FROM occurrences o LEFT JOIN spelled s ON s.word = o.word GROUP BY o.id)
SELECT d.doc_id AS id, coalesce(t.input_ids, '') AS input_ids
FROM documents d LEFT JOIN texts t ON t.id = d.doc_id"""


def word_split_folded(spark, sf):
    docs = spread_samples(spark, sf).select("id", words(fold_marks(F.lower("text"))).alias("w"))
    return docs.select("id", F.array_join("w", " ").alias("words"))


def vocabulary_file(spark, sf):
    """The vocabulary written as text files, a word a line, and read back by line number."""
    path = new_path(spark, "vocabulary")
    write_vocabulary(tokens.vocabulary(spread_samples(spark, sf)), path, "token")
    return read_vocabulary(spark, path)


def _short_pieces(spark, sf):
    """All runs of one to three letters in the tokens of ``conversations``, for starts and insides of words."""
    tokens_ = table(spark, sf, "conversations").select(F.explode(words_and_marks(F.col("text"))).alias("token")).distinct()
    length = F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(3)))).alias("n")
    runs = tokens_.select("token", length).select(
        "token", "n", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1)).alias("at")
    )
    starts = runs.select(F.substring("token", F.col("at"), F.col("n")).alias("piece")).distinct()
    inside = starts.select(F.concat(F.lit(sub.CONTINUATION), "piece").alias("piece"))
    return tokens.with_dense_ids(starts.union(inside), [F.asc("piece")], "token_id", start=len(tokens.RESERVED))


def subword_encode(spark, sf):
    """Texts to padded piece ids, by a pipeline that was fitted on a vocabulary file, saved and loaded."""
    reserved = spark.createDataFrame(list(enumerate(tokens.RESERVED)), "token_id int, piece string")
    path = new_path(spark, "vocabulary")
    write_vocabulary(_short_pieces(spark, sf).unionByName(reserved), path)
    docs = spread_samples(spark, sf)
    saved = new_path(spark, "encoder")
    Pipeline(stages=[SubwordEncoder(vocabularyPath=path)]).fit(docs).write().save(saved)
    encoded = PipelineModel.load(saved).transform(docs)
    return encoded.select("id", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


SUBWORD_ENCODE = rf"""
WITH RECURSIVE
turn_tokens AS (SELECT DISTINCT unnest({MARKS}) AS token FROM conversations),
sizes AS (SELECT token, unnest(range(1, least(length(token), 3) + 1)) AS n FROM turn_tokens),
runs AS (SELECT token, n, unnest(range(1, length(token) - n + 2)) AS place FROM sizes),
parts AS (SELECT DISTINCT substring(token, place, n) AS piece FROM runs),
vocab AS (
  SELECT piece, row_number() OVER (ORDER BY piece) + 3 AS token_id
  FROM (SELECT piece FROM parts UNION ALL SELECT '##' || piece FROM parts)),
kept AS (SELECT doc_id AS id, list_slice({MARKS}, 1, 62) AS words FROM documents),
occurrences AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM kept),
distinct_words AS (SELECT DISTINCT word FROM occurrences),
hits AS (
  SELECT s.word, s.start, s.len, v.token_id, row_number() OVER (PARTITION BY s.word, s.start ORDER BY s.len DESC) AS rn
  FROM (SELECT word, start, unnest([1, 2, 3]) AS len
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM distinct_words)) s
  JOIN vocab v ON v.piece = CASE WHEN s.start > 1 THEN '##' ELSE '' END || substring(s.word, s.start, s.len)
  WHERE s.start + s.len <= length(s.word) + 1),
walk AS (
  SELECT word, CAST(1 AS BIGINT) AS reached, CAST([] AS BIGINT[]) AS ids FROM distinct_words
  UNION ALL
  SELECT w.word, w.reached + h.len, list_append(w.ids, h.token_id)
  FROM walk w JOIN hits h ON h.word = w.word AND h.start = w.reached AND h.rn = 1),
spelled AS (SELECT word, ids FROM walk WHERE reached = length(word) + 1),
texts AS (
  SELECT o.id, list_slice(flatten(list(coalesce(s.ids, [1]) ORDER BY o.pos)), 1, 62) AS ids
  FROM occurrences o LEFT JOIN spelled s ON s.word = o.word GROUP BY o.id),
ended AS (
  SELECT k.id, list_concat([2], coalesce(t.ids, CAST([] AS BIGINT[])), [3]) AS ids FROM kept k LEFT JOIN texts t ON t.id = k.id)
SELECT id, array_to_string(ids, ',') || repeat(',0', 64 - len(ids)) AS input_ids,
       '1' || repeat(',1', len(ids) - 1) || repeat(',0', 64 - len(ids)) AS attention_mask
FROM ended"""


QUERIES = {
    "word_split": (
        word_split,
        f"""SELECT id, CAST(len(w) AS INTEGER) AS n_words, coalesce(array_to_string(w, ' '), '') AS words
            FROM (SELECT doc_id AS id, {WORDS} AS w FROM documents)""",
    ),
    "word_split_marks": (
        word_split_marks,
        f"""SELECT id, CAST(len(w) AS INTEGER) AS n_tokens, coalesce(array_to_string(w, ' '), '') AS tokens
            FROM (SELECT doc_id AS id, {MARKS} AS w FROM documents)""",
    ),
    "vocabulary": (vocabulary, f"WITH {VOCABULARY} SELECT token, n, doc_freq, token_id FROM vocab"),
    "frequent_words": (frequent_words, f"WITH {VOCABULARY} {FREQUENT}"),
    "encode_ids": (encode_ids, f"WITH {VOCABULARY} {ENCODE}"),
    "pad_mask": (pad_mask, PAD_MASK),
    "subword_pieces": (subword_pieces, f"{SUBWORDS} SELECT word, pieces FROM spelled"),
    "subword_ids": (subword_ids, SUBWORD_IDS),
    "word_split_folded": (
        word_split_folded,
        f"""SELECT id, coalesce(array_to_string(w, ' '), '') AS words
            FROM (SELECT doc_id AS id, {WORDS} AS w FROM (SELECT doc_id, strip_accents(lower(text)) AS text FROM documents))""",
    ),
    "vocabulary_file": (vocabulary_file, f"WITH {VOCABULARY} SELECT token AS piece, token_id FROM vocab"),
    "subword_encode": (subword_encode, SUBWORD_ENCODE),
}
