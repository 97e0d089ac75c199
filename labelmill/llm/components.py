"""Connected components of a table of links, by passing on the smallest label and jumping ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the label is its component's smallest node.

    Each round gives a node the smallest label next to it and then that label's own label, so a
    chain shrinks by half; a table is written per round, and only counts reach the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "links")
    labels = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = lower.join(ahead, "label", "left").select("node", F.least("label", "far").alias("label"), "was")
        written = materialize(jumped, "labels")
        labels = written.select("node", "label")
        if written.where("label <> was").isEmpty():
            return labels
