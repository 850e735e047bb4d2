"""Connected components of a list of links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of (a, b): label is the smallest node that it reaches.

    In a round every node takes the smallest label among its neighbours' and its own, and then the label of that label,
    so the distance to go about halves. A node with very many links is a key that Spark may split: the sides of the
    join are links and one row per node, and minima are taken before the shuffle."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:  # labels only get smaller, so it ends
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        after = materialise(stepped.join(up, "label", "left").select("node", "old", F.coalesce("upper", "label").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old != label").limit(1).count() == 0:
            return labels
