"""Cells to directed edges. A cell is (i, r, c, h, m); masked cells are filtered out before anything joins them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvora.functions.cost import Cost, edge_cost
from kelvora.operators.moves import Move


@dataclass(frozen=True)
class Grid:
    rows: int
    cols: int
    dx: float = 30.0
    dy: float = 30.0


def passable(cells: DataFrame) -> DataFrame:
    """Open cells. What joins them is merged, as a table's file can be small enough for a broadcast that its rows aren't."""
    return cells.where("m").select("i", "r", "c", F.col("h").cast("double").alias("h")).hint("merge")


def neighbours(cells: DataFrame, grid: Grid, moves: Sequence[Move], targets: DataFrame | None = None) -> DataFrame:
    """(u, v, k, dist, hu, hv): moves are literals in one explode, and the only shuffle is the join on the target cell, which
    is one of cells, or of targets where they are named."""
    own = passable(cells)
    steps = F.array(*[F.struct(F.lit(m.k).alias("k"), F.lit(m.dr).alias("dr"), F.lit(m.dc).alias("dc"), F.lit(m.dist).alias("dist")) for m in moves])
    out = own.select(F.col("i").alias("u"), "r", "c", F.col("h").alias("hu"), F.explode(steps).alias("x"))
    tr, tc = F.col("r") + F.col("x.dr"), F.col("c") + F.col("x.dc")
    inside = out.where((tr >= 0) & (tr < grid.rows) & (tc >= 0) & (tc < grid.cols)).select("u", "hu", F.col("x.k").alias("k"), F.col("x.dist").alias("dist"), (tr.cast("long") * grid.cols + tc).alias("v"))
    ends = own if targets is None else passable(targets)
    return inside.join(ends.select(F.col("i").alias("v"), F.col("h").alias("hv")), "v").select("u", "v", "k", "dist", "hu", "hv")


def unit_edges(cells: DataFrame, grid: Grid, cost: Cost, moves: Sequence[Move]) -> DataFrame:
    return neighbours(cells, grid, [m for m in moves if not m.is_long]).select("u", "v", "k", edge_cost(F.col("dist"), F.col("hv") - F.col("hu"), cost).alias("w"), F.lit(False).alias("is_long"))


def long_edges(cells: DataFrame, grid: Grid, cost: Cost, moves: Sequence[Move]) -> DataFrame:
    """Edges of long moves: heights are sampled along them and every step is costed; one sample over a masked cell blocks."""
    own = passable(cells)
    reach = neighbours(cells, grid, [m for m in moves if m.is_long])
    by_k = F.create_map(*[x for m in moves if m.is_long for x in (F.lit(m.k), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(tr).alias("tr"), F.lit(tc).alias("tc")) for s, a, b, tr, tc in m.samples]))])
    steps = F.create_map(*[x for m in moves if m.is_long for x in (F.lit(m.k), F.lit(m.steps))])
    at = reach.select("u", "v", "k", "hu", "hv", (F.col("dist") / steps[F.col("k")]).alias("sub"), F.explode(by_k[F.col("k")]).alias("x"))
    corner = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a * grid.cols + b).alias("d")) for q, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))])).alias("y")
    support = at.select("u", "v", "k", "hu", "hv", "sub", "x", (F.col("u") + F.col("x.a") * grid.cols + F.col("x.b")).alias("b0"), corner)
    held = support.withColumn("at", F.col("b0") + F.col("y.d")).join(own.select(F.col("i").alias("at"), F.col("h").alias("ha")), "at")
    pick = lambda q: F.max(F.when(F.col("y.q") == q, F.col("ha")))
    sampled = held.groupBy("u", "v", "k", "hu", "hv", "sub", F.col("x.s").alias("s"), F.col("x.tr").alias("tr"), F.col("x.tc").alias("tc")).agg(F.count("*").alias("n"), *[pick(q).alias(f"h{q}") for q in range(4)]).where("n = 4")
    tr, tc = F.col("tr"), F.col("tc")
    level = F.col("h0") * (1 - tr) * (1 - tc) + F.col("h1") * (1 - tr) * tc + F.col("h2") * tr * (1 - tc) + F.col("h3") * tr * tc
    lists = sampled.withColumn("hs", level).groupBy("u", "v", "k", "hu", "hv", "sub").agg(F.sort_array(F.collect_list(F.struct("s", "hs"))).alias("p")).where(F.size("p") == steps[F.col("k")] - 1)
    heights = F.concat(F.array("hu"), F.transform("p", lambda x: x["hs"]), F.array("hv"))
    profile = lists.withColumn("hh", heights)
    total = F.aggregate(F.sequence(F.lit(1), F.size("hh") - 1), F.lit(0.0), lambda acc, j: acc + edge_cost(F.col("sub"), F.col("hh")[j] - F.col("hh")[j - 1], cost))
    return profile.select("u", "v", "k", total.alias("w"), F.lit(True).alias("is_long"))


def seed_edges(cells: DataFrame, passable_cells: DataFrame, grid: Grid, cost: Cost, moves: Sequence[Move], seeds: DataFrame) -> DataFrame:
    """Edges between seeds (.., i) that aren't passable themselves and the passable cells around them, both ways: a search
    from a masked cell begins there, and no other search passes it. Unit moves only."""
    closed = cells.join(seeds.select("i").distinct(), "i", "left_semi").join(passable_cells.where("m").select("i"), "i", "left_anti").withColumn("m", F.lit(True))
    unit = [m for m in moves if not m.is_long]
    out = neighbours(closed.select("i", "r", "c", "h", "m"), grid, unit, passable_cells)
    there = out.select("u", "v", "k", edge_cost(F.col("dist"), F.col("hv") - F.col("hu"), cost).alias("w"), F.lit(False).alias("is_long"))
    back = out.select(F.col("v").alias("u"), F.col("u").alias("v"), "k", edge_cost(F.col("dist"), F.col("hu") - F.col("hv"), cost).alias("w"), F.lit(False).alias("is_long"))
    return there.union(back)


def portal_edges(portals: DataFrame, cells: DataFrame, cost: Cost) -> DataFrame:
    """Deck shortcuts (u, v, len_m, hu, hv) in both directions; an end without its own height has its cell's."""
    own = passable(cells)
    held = (
        portals.where("u != v and u >= 0 and v >= 0")
        .join(own.select(F.col("i").alias("u"), F.col("h").alias("gu")), "u")
        .join(own.select(F.col("i").alias("v"), F.col("h").alias("gv")), "v")
        .select("u", "v", "len_m", F.coalesce(F.when(F.isnan("hu"), None).otherwise(F.col("hu")), "gu").alias("hu"), F.coalesce(F.when(F.isnan("hv"), None).otherwise(F.col("hv")), "gv").alias("hv"))
    )
    there = held.select("u", "v", edge_cost(F.col("len_m"), F.col("hv") - F.col("hu"), cost).alias("w"))
    back = held.select(F.col("v").alias("u"), F.col("u").alias("v"), edge_cost(F.col("len_m"), F.col("hu") - F.col("hv"), cost).alias("w"))
    return there.union(back).select("u", "v", F.lit(-1).alias("k"), "w", F.lit(False).alias("is_long"))


def edges(cells: DataFrame, grid: Grid, cost: Cost, moves: Sequence[Move], portals: DataFrame | None = None, network: DataFrame | None = None) -> DataFrame:
    """All directed edges (u, v, k, w, is_long); network (i) keeps only its cells."""
    own = cells.join(network.select("i").distinct(), "i", "left_semi") if network is not None else cells
    out = unit_edges(own, grid, cost, moves)
    if any(m.is_long for m in moves):
        out = out.union(long_edges(own, grid, cost, moves))
    return out.union(portal_edges(portals, own, cost)) if portals is not None else out


def reversed_edges(edge: DataFrame) -> DataFrame:
    """The transpose: a search over it measures travel towards its seed."""
    return edge.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edge.columns if c not in ("u", "v")])


def inverted(edge: DataFrame, bound: float) -> DataFrame:
    """Costs turned round for the maximising field."""
    return edge.withColumn("w", F.greatest(F.lit(0.0), F.lit(bound) - F.col("w")))
