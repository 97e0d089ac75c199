"""Greedy longest-match sub-word segmentation of distinct words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.piece_trie import CONTINUATION, collect_trie
from labelmill.operators.tokens import UNK
from labelmill.operators.word_lookup import with_word_ids
from labelmill.functions.text import words
from labelmill.scratch import lookup_join, materialize


def segment_words(distinct_words: DataFrame, vocab: DataFrame, max_word_chars: int | None = None) -> DataFrame:
    """(word, pieces, piece_ids) for every word that ``vocab(piece, token_id)`` can spell, longest match first.

    A vocabulary within the bounds of :mod:`piece_trie` is walked letter by letter, without any
    further row; a larger one is joined. A word of more than ``max_word_chars`` characters, where
    that is given, has no row.
    """
    if max_word_chars is not None:
        distinct_words = distinct_words.where(F.length("word") <= max_word_chars)
    trie = collect_trie(vocab)
    if trie is None:
        return join_substrings(distinct_words, vocab)
    walked = distinct_words.select("word", trie.walk(F.array("word"))[0].alias("spelled")).where("spelled IS NOT NULL")
    return walked.select(
        "word",
        trie.piece_texts(F.col("spelled")).alias("pieces"),
        trie.piece_ids(F.col("spelled")).alias("piece_ids"),
    )


def join_substrings(distinct_words: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same for a vocabulary of any size.

    All substrings as long as some piece are looked up; the longest hit per start is kept
    and the hits are chained from the first character on. A word with a gap has no row.
    """
    bare = F.regexp_replace("piece", f"^{CONTINUATION}", "")
    sizes = vocab.agg(F.sort_array(F.collect_set(F.length(bare)))).first()[0]  # lengths of pieces that occur
    size = F.length("word")
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    spans = (
        distinct_words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start"))
        .select("word", "start", F.explode(F.filter(lengths, lambda n: n <= size - F.col("start") + 1)).alias("len"))
        .withColumn(
            "piece",
            F.concat(
                F.when(F.col("start") > 1, F.lit(CONTINUATION)).otherwise(F.lit("")),
                F.substring("word", F.col("start"), F.col("len")),
            ),
        )
    )
    found = lookup_join(spans, vocab.select("piece", "token_id"), "piece", "word", "inner")
    # Length and id in one number: its maximum is the longest piece, in a fixed-size buffer.
    packed = F.shiftleft(F.col("len").cast("bigint"), 32) + F.col("token_id")
    best = found.groupBy("word", "start").agg(F.max(packed).alias("hit"))
    by_word = best.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "hit"))).alias("hits")
    )

    begin = F.struct(
        F.lit(1).alias("next"),
        F.array().cast("array<string>").alias("pieces"),
        F.array().cast("array<int>").alias("ids"),
    )

    def step(acc, i):
        hit = F.col("hits")[i]
        length = F.shiftright(hit, 32).cast("int")
        mark = F.when(i > 1, F.lit(CONTINUATION)).otherwise(F.lit(""))
        piece = F.concat(mark, F.substring(F.col("word"), i, length))
        return F.when(
            (acc["next"] == i) & hit.isNotNull(),
            F.struct(
                (i + length).alias("next"),
                F.concat(acc["pieces"], F.array(piece)).alias("pieces"),
                F.concat(acc["ids"], F.array(hit.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("ids"),
            ),
        ).otherwise(acc)

    return (
        by_word.withColumn("walk", F.aggregate(F.sequence(F.lit(1), size), begin, step))
        .where(F.col("walk.next") == size + 1)
        .select("word", F.col("walk.pieces").alias("pieces"), F.col("walk.ids").alias("piece_ids"))
    )


def subwords(
    df: DataFrame,
    vocab: DataFrame,
    id: str = "id",
    text: str = "text",
    max_word_chars: int | None = None,
    unk_id: int = UNK,
) -> DataFrame:
    """(id, input_ids): piece ids per text; a word that cannot be spelled becomes one [UNK].

    Only distinct words are segmented; the texts then look their words up. Rows that share an id
    stay rows of their own.
    """
    texts = materialize(df.select(id, words(F.col(text)).alias("_words")), "words")
    counted = texts.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = materialize(counted, "distinct-words")
    dealt = counted.select("word").repartition("word")  # the substrings of a word then stay where it is
    spelled = materialize(segment_words(dealt, vocab, max_word_chars).select("word", "piece_ids"), "segmented")
    unknown = F.array(F.lit(unk_id))
    known = counted.join(spelled, "word", "left").select("word", "n", F.coalesce("piece_ids", unknown).alias("ids"))
    return with_word_ids(texts, "_words", materialize(known, "known"), F.col("n"), unk_id, "input_ids").select(id, "input_ids")
