"""Curate a corpus: union, keep-first de-duplication, balance, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators import curate, sampling
from labelmill.scratch import materialize
from labelmill.sources.samples import write_samples


def distinct_corpus(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources, one row per text, with ``id`` made from the text.

    An id from the text does not depend on where the row stood, so curating the result
    again picks the same rows.
    """
    kept = curate.dedup_keep_first(curate.union_sources(sources))
    return materialize(kept.withColumn("id", F.coalesce(F.sha2("text", 256), F.lit("null text"))), "corpus")


def curated(sources: Sequence[DataFrame], seed: int = 42) -> DataFrame:
    """Balanced distinct corpus, clustered by label. Sorting by (label, id) splits big labels."""
    return sampling.balance(distinct_corpus(sources), seed=seed).sort("label", "id")


def curate_to(sources: Sequence[DataFrame], path: str, fmt: str = "csv", seed: int = 42) -> DataFrame:
    """Write the curated corpus over ``path`` (which may be one of the sources).

    Returns the class counts of what was written, by label.
    """
    result = materialize(curated(sources, seed), "curated")
    write_samples(result.select("text", "label"), path, fmt)
    return curate.class_counts(result).orderBy("label")
