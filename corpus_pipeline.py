"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

In every stage rows are told apart by their place in the written table, so null and repeated ids are
rows of their own; other columns pass through whatever their names; an empty table stays empty;
null texts count as empty; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from labelmill.llm.queries import vocabulary
from labelmill.llm.ship import ship
from labelmill.llm.skew import free_name, with_row_id, without_rows
from labelmill.scratch import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those far from every language learned from the labels, go.

    The floor of the score lies below those of all held-out labelled documents; without labels only documents
    without a letter go. Null and empty texts have no letter. Very long texts are classified whole.
    """
    ship(spark)
    row_col = free_name(docs.columns, "__row_id")
    keyed = with_row_id(docs, row_col)
    return without_rows(keyed, materialize(language_id.rejected_rows(keyed, row_col), "dropped"), row_col)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one row stays: the longest, then the one with the smallest id.

    Null, empty and blank texts are equal to each other. Among repeated rows the first place stays.
    """
    ship(spark)
    row_col = free_name(docs.columns, "__row_id")
    keyed = with_row_id(docs, row_col)
    found = exact_dedup.dedup(keyed, row_col=row_col)
    return without_rows(keyed, materialize(found.where("NOT kept").select("row_id"), "dropped"), row_col)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near-duplicates, one row stays: that with the smallest id, null ids last, then by place.

    Texts of fewer than five words are alike only if their words are equal.
    """
    ship(spark)
    row_col = free_name(docs.columns, "__row_id")
    keyed = with_row_id(docs, row_col)
    found = near_dedup.near_dedup(keyed, row_col=row_col)
    return without_rows(keyed, materialize(found.where("NOT kept").select("row_id"), "dropped"), row_col)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all but their first document.

    Such a text becomes its kept words with one blank between them, and stays even if none is left; others, null
    ones too, stay as they are. Rows that share an id take no words from each other, and null ids come last.
    """
    ship(spark)
    found = substring_dedup.remove_repeats(docs, keep=True)
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of fixed windows of tokens; a null or empty text is its end token alone."""
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("substring_dedup", without_repeats),
    ("packing", packed),
]

#: Language, near-duplicates and tokenizing cannot be told in SQL; a test holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
