"""Connected components of links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvora.operators.search import written


def components(links: DataFrame) -> DataFrame:
    """(n, label) of every node of links (a, b): the smallest node that it is linked with, itself included. Each round a node
    takes the least label around it and then that label's own, so that what is left to go about halves."""
    one = links.select("a", "b")
    both = written(one.union(one.select("b", "a")).distinct(), "links")
    now = written(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        offered = both.join(now.select(F.col("n").alias("b"), "label"), "b").groupBy(F.col("a").alias("n")).agg(F.min("label").alias("offer"))
        lower = now.join(offered, "n").select("n", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        jump = now.select(F.col("n").alias("label"), F.col("label").alias("next"))
        after = written(lower.join(jump, "label").select("n", "was", F.col("next").alias("label")), "labels")
        now = after.select("n", "label")
        if after.where("label < was").limit(1).count() == 0:
            return now
