"""Running sums and ranks over a whole table, in two levels: within ranges of the order, and over the ranges.

Only one row per range, as many as the cluster has partitions, meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvora.operators.search import written


def ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with part: rows of a smaller part come before those of a larger one, and equal keys share a part. Written, so that
    a part stays what it is when a task is run again."""
    return written(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")


def running_sum(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to each row and its equals, in the order of keys."""
    own = ranged(df, keys)
    parts = own.groupBy("part").agg(F.sum(value).alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("of_earlier"))
    within = F.sum(value).over(Window.partitionBy("part").orderBy(*keys))
    return own.join(before, "part").withColumn(name, F.col("of_earlier") + within).drop("part", "of_earlier")


def _sorted_groups(values: DataFrame, by: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values (group, value, part) in ranges of their order, and (group, part, held, before, n): where each range stands."""
    own = ranged(values.select(F.col(by).alias("group"), F.col(value).alias("value")).where("value is not null"), ["group", "value"])
    sizes = own.groupBy("group", "part").agg(F.count("*").alias("held"))
    group = Window.partitionBy("group")
    return own, sizes.select("group", "part", "held", (F.sum("held").over(group.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(group).alias("n"))


def _at(own: DataFrame, asked: DataFrame) -> DataFrame:
    """(group, n, name, value) of places asked for (group, part, before, held, n, name, at), counted from 0 in their group."""
    here = asked.where("at >= before and at < before + held").select("group", "part", F.struct("n", "name", (F.col("at") - F.col("before") + 1).alias("at")).alias("x"))
    # Sorted values are small files of many rows, which mustn't be broadcast; parts that nothing is asked of aren't ranked.
    held = own.hint("merge").join(here.groupBy("group", "part").agg(F.collect_list("x").alias("asked")), ["group", "part"])
    ranked = held.withColumn("at", F.row_number().over(Window.partitionBy("group", "part").orderBy("value")))
    hit = ranked.withColumn("x", F.explode(F.filter("asked", lambda x: x["at"] == F.col("at"))))
    return hit.select("group", "x.n", "x.name", "value")


def quantiles(values: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column per share): the sorted value at floor(share * n), held below n."""
    own, placed = _sorted_groups(values, by, value)
    asked = placed.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))).alias("at")) for k, p in shares.items()])))
    hit = _at(own, asked.select("group", "part", "before", "held", "n", "x.name", "x.at"))
    return hit.groupBy(F.col("group").alias(by)).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in shares])


def at_places(values: DataFrame, by: str, value: str, places: DataFrame) -> DataFrame:
    """(by, name, value): a group's sorted value at each of the places (by, name, at) that are asked of it, counted from 0 and
    held below its size; places below 0 have none."""
    own, placed = _sorted_groups(values, by, value)
    asked = placed.join(places.where("at >= 0").select(F.col(by).alias("group"), "name", F.col("at").alias("wanted")), "group")
    hit = _at(own, asked.withColumn("at", F.least(F.col("n") - 1, "wanted")))
    return hit.select(F.col("group").alias(by), "name", "value")
