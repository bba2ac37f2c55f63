"""Connected components over links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import cut, merging


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node of its
    component. Self-links make a node known; nulls never link; no links give no rows.

    Each round takes the smallest label among a node's neighbours, then jumps to that label's own
    label, so a path of n links settles in about log n rounds and a star in two. Hubs are folded by
    partial aggregation; rounds end in reliable checkpoints, of at most so many parts."""
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), parts)
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), parts)
    while True:
        near = edges.join(merging(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(merging(near), "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = cut(hooked.join(merging(jump), "next").select("node", "label", F.least("next", "far").alias("next")), parts)
        changed = moved.where(F.col("next") != F.col("label")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
