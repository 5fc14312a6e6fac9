"""Connected components of a link table by minimum labels with pointer
jumping. Labels and links stay distributed; the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``links``: columns a, b. Returns (node, label) for every node of a
    link; label is the smallest node of its component."""
    both = links.select("a", "b").where("a <> b")
    edges = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        # the smallest label among the neighbours, then the label of that label
        near = (edges.join(label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l")))
        hop = label.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("new"))
        up = label.select(F.col("node").alias("new"), F.col("label").alias("far"))
        nxt = cut(hop.join(up, "new", "left").select(
            "node", "old", F.least("new", F.coalesce("far", "new")).alias("label")))
        changed = nxt.filter("old <> label").limit(1).count()
        label = nxt.select("node", "label")
        if not changed:
            return label
    raise RuntimeError("components did not settle")
