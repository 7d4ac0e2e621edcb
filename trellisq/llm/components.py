"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the label is the smallest node that can be reached.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so chains shorten by halves and stars end in two
    rounds.  Frequent nodes meet pre-aggregated minima and joins that Spark can
    split.  No links give no rows.
    """
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = stored(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"))
        if not labels.where("label != old").limit(1).count():
            return labels.drop("old")
        labels = labels.drop("old")
