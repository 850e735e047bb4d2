"""Shortest-path trees as joins: parents, depths, passes, long-move stamps and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvora.operators.moves import Move
from kelvora.operators.search import written


def parents(edge: DataFrame, field: DataFrame, seeds: DataFrame) -> DataFrame:
    """(k, i, e, parent): the neighbour through which a node is cheapest, ties to the smaller id. A seed has none."""
    via = field.select("k", F.col("i").alias("u"), F.col("e").alias("eu")).join(edge.select("u", "v", "w"), "u").select("k", F.col("v").alias("i"), F.struct((F.col("eu") + F.col("w")).alias("cost"), F.col("u").alias("u")).alias("x"))
    best = via.groupBy("k", "i").agg(F.min("x")["u"].alias("parent"))
    seed = seeds.select("k", "i", F.lit(True).alias("seed")).distinct()
    return field.join(best, ["k", "i"], "left").join(seed, ["k", "i"], "left").select("k", "i", "e", F.when(F.col("seed").isNull(), F.col("parent")).alias("parent"))


def _doubled(up: DataFrame) -> DataFrame:
    """(k, i, anc, hops), each node's way up made twice as long; it ends at the root, which is its own ancestor."""
    other = up.select("k", F.col("i").alias("anc"), F.col("anc").alias("next"), F.col("hops").alias("more"))
    return written(up.join(other, ["k", "anc"]).select("k", "i", F.col("next").alias("anc"), (F.col("hops") + F.col("more")).alias("hops")), "up")


def _ways_up(tree: DataFrame) -> DataFrame:
    return written(tree.select("k", "i", F.coalesce("parent", "i").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("hops")), "up")


def tree_of(edge: DataFrame, field: DataFrame, seeds: DataFrame) -> DataFrame:
    """The columns of search.TREE."""
    own = written(parents(edge, field, seeds), "tree")
    return passes(own)


def passes(tree: DataFrame, include: DataFrame | None = None, tiling=None) -> DataFrame:
    """Adds depth and passes, the included nodes (all, or those of include (k, i)) in a node's subtree; with a tiling by tiles.

    What is less than 2 n hops below a node is what is less than n hops below it and below the nodes n hops below it, so
    sums and ways up double together: a row a node and as many rounds as the depth has bits."""
    if tiling is not None:
        from kelvora.operators import tiles

        return tiles.passes(tree, tiling, include)
    up, n = _ways_up(tree), 1
    sums = tree.select("k", "i", F.lit(1.0).alias("passes"))
    if include is not None:
        flags = include.select("k", "i", F.lit(1.0).alias("flag")).distinct()
        sums = tree.select("k", "i").join(flags, ["k", "i"], "left").select("k", "i", F.coalesce("flag", F.lit(0.0)).alias("passes"))
    sums = written(sums, "passes")
    while True:
        exact = up.where(F.col("hops") == n)
        if exact.limit(1).count() == 0:
            break
        below = exact.join(sums, ["k", "i"]).groupBy("k", F.col("anc").alias("i")).agg(F.sum("passes").alias("below"))
        sums = written(sums.join(below, ["k", "i"], "left").select("k", "i", (F.col("passes") + F.coalesce("below", F.lit(0.0))).alias("passes")), "passes")
        up, n = _doubled(up), 2 * n
    depth = up.select("k", "i", F.col("hops").cast("int").alias("depth"))
    return tree.select("k", "i", "e", "parent").join(depth, ["k", "i"]).join(sums, ["k", "i"]).select("k", "i", "e", "parent", "depth", "passes")


def stamped(tree: DataFrame, edge: DataFrame, moves: Sequence[Move], cols: int) -> DataFrame:
    """(k, i, passes) with the flow of long tree edges added to the reached cells they pass over. Flows are those before
    any stamp; unit moves and portals never stamp."""
    sweeps = F.create_map(*[x for m in moves if m.is_long for x in (F.lit(m.k), F.array(*[F.lit(a * cols + b).cast("long") for a, b in m.sweep]))])
    used = tree.where("parent is not null").join(edge.where("is_long").select(F.col("u").alias("parent"), F.col("v").alias("i"), F.col("k").alias("move")), ["parent", "i"])
    stamps = used.select("k", "passes", F.explode(F.transform(sweeps[F.col("move")], lambda d: F.col("parent") + d)).alias("i"))
    held = stamps.join(tree.select("k", "i"), ["k", "i"], "left_semi").select("k", "i", "passes")
    return tree.select("k", "i", "passes").union(held).groupBy("k", "i").agg(F.sum("passes").alias("passes"))


def path_to(tree: DataFrame, goals: DataFrame, tiling) -> DataFrame:
    """``path`` with one goal a seed, by tiles: its way are the nodes that have it in their subtree. tree is (k, i, e, parent)."""
    from kelvora.operators import tiles

    found = tiles.passes(tree.select("k", "i", "e", "parent"), tiling, goals.select("k", F.col("goal").alias("i")))
    return found.where("passes > 0").join(goals.select("k", "goal").distinct(), "k").select("k", "goal", F.col("depth").cast("int").alias("seq"), "i", "e")


def path(tree: DataFrame, goals: DataFrame) -> DataFrame:
    """(k, goal, seq, i, e) from the seed to goals (k, goal). Only goals' ways are followed: each round adds to what is
    known of them as much again."""
    up, n = _ways_up(tree), 1
    known = written(goals.select("k", "goal", F.col("goal").alias("i")).distinct().join(tree.select("k", "i"), ["k", "i"], "left_semi").select("k", "goal", "i"), "ways")
    while True:
        exact = up.where(F.col("hops") == n).select("k", "i", "anc")
        more = written(known.join(exact, ["k", "i"]).select("k", "goal", F.col("anc").alias("i")), "more")
        if more.limit(1).count() == 0:
            break
        known, up, n = written(known.union(more), "ways"), _doubled(up), 2 * n
    nodes = known.join(tree.select("k", "i", "e", "depth"), ["k", "i"])
    return nodes.select("k", "goal", F.col("depth").cast("int").alias("seq"), "i", "e")


def path_length(route: DataFrame, cols: int, dx: float, dy: float) -> DataFrame:
    """(k, goal, length_m) of (k, goal, seq, i)."""
    by = Window.partitionBy("k", "goal").orderBy("seq")
    r, c = F.floor(F.col("i") / cols), F.pmod("i", F.lit(cols))
    step = route.select("k", "goal", "seq", r.alias("r"), c.alias("c")).select("k", "goal", F.hypot((F.col("r") - F.lag("r").over(by)) * dy, (F.col("c") - F.lag("c").over(by)) * dx).alias("d"))
    return step.groupBy("k", "goal").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"))
