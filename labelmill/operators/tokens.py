"""Word tables, vocabulary, id encoding, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelmill.functions.text import NON_WORD, words
from labelmill.operators.word_lookup import with_word_ids
from labelmill.scratch import materialize

# Reserved tokens in id order, and the longest encoded text (both ends included).
RESERVED = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
PAD, UNK, CLS, SEP = range(4)
MAX_LENGTH = 64


def word_rows(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """One row per word occurrence; a text without words still gives one row, with token ''."""
    return df.select(*keep, F.explode_outer(F.split(F.lower(text), NON_WORD)).alias("token"))


def token_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, doc_freq): occurrences, and texts with the token, in one aggregation.

    Each text contributes its words and its distinct words, so no (text, token) pair is
    shuffled and frequent tokens are summed inside each task first.
    """
    both = F.posexplode(F.array("w", F.array_distinct("w"))).alias("kind", "w")
    return (
        df.select(words(F.col(text)).alias("w"))
        .select(both)
        .select("kind", F.explode("w").alias("token"))
        .groupBy("token")
        .agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("doc_freq"))
    )


def with_dense_ids(
    df: DataFrame, order: Sequence[Column | str], out: str, start: int = 0, kind: str = "int"
) -> DataFrame:
    """Number the rows start, start+1, ... in ``order``, without one task seeing them all.

    The table is range-partitioned and written with its partition number; a row's id is the
    number of rows in earlier partitions plus its rank in its own. ``order`` must be unique.
    """
    placed = materialize(df.sort(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(before), "_part")  # one row per partition
        .withColumn(out, (F.col("_before") + F.col("_rank") + (start - 1)).cast(kind))
        .drop("_part", "_before", "_rank")
    )


def vocabulary(df: DataFrame, text: str = "text", min_df: int = 1) -> DataFrame:
    """(token, n, doc_freq, token_id): most frequent first, ids after the reserved ones."""
    kept = token_stats(df, text).where(F.col("doc_freq") >= min_df)
    return with_dense_ids(kept, [F.desc("n"), F.asc("token")], "token_id", start=len(RESERVED))


def encode_ids(
    df: DataFrame,
    vocab: DataFrame,
    id: str = "id",
    text: str = "text",
    keep: Sequence[str] = (),
    max_length: int | None = None,
) -> DataFrame:
    """(id, *keep, input_ids): token ids between [CLS] and [SEP], [UNK] for unknown words.

    ``max_length`` truncates to that many positions, both ends included. Labels travel in
    ``keep``, so they never have to be aligned again.
    """
    toks = words(F.col(text))
    if max_length is not None:
        toks = F.slice(toks, 1, max_length - 2)
    known = vocab.select(F.col("token").alias("word"), "token_id", F.array(F.col("token_id").cast("int")).alias("ids"))
    texts = df.select(id, *keep, toks.alias("_words"))
    # ids of a vocabulary follow frequency, the most frequent word first
    found = with_word_ids(texts, "_words", materialize(known, "known"), -F.col("token_id"), UNK, "_ids")
    return found.select(id, *keep, F.concat(F.array(F.lit(CLS)), "_ids", F.array(F.lit(SEP))).alias("input_ids"))


def pad_and_mask(
    df: DataFrame, ids: str = "input_ids", max_length: int | None = None, by: str | None = None
) -> DataFrame:
    """Pad ``ids`` to the longest row of ``df`` and add ``attention_mask``.

    With ``by``, a column of few values such as the fold, each of its values has its own longest row.
    Reads ``df`` once for the longest rows; materialize it first if it is costly.
    """
    key = F.lit(0) if by is None else F.col(by)
    longest = df.groupBy(key.alias("_by")).agg(F.max(F.size(ids)).alias("_longest"))
    if max_length is not None:
        longest = longest.withColumn("_longest", F.least("_longest", F.lit(max_length)))
    longest = longest.withColumnRenamed("_by", "_of")
    sized = df.withColumn("_by", key).join(F.broadcast(longest), F.col("_by").eqNullSafe(F.col("_of"))).drop("_by", "_of")
    gap = F.greatest(F.col("_longest") - F.size(ids), F.lit(0))
    real = F.array_repeat(F.lit(1), F.size(ids))
    padded = sized.withColumn("attention_mask", F.concat(real, F.array_repeat(F.lit(0), gap)))
    return padded.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(PAD), gap))).drop("_longest")
