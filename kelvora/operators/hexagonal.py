"""A lattice of hexagons over the grid's ground: nodes on axial coordinates with bilinear heights, and edges that any search takes.

Node (q, r) stands at x = a (q + r / 2), y = a sqrt(3) / 2 r, a being the lesser side of a cell; it is there where the nearest
cell is open and the four cells around it have heights. Six moves lead to the next nodes, six more, on request, to those
sqrt(3) a away, costed in two halves with the ground's height between them. A node is numbered along rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.functions.cost import Cost, edge_cost
from kelvora.operators.grid import Grid

#: Of the moves (dq, dr), those of one half; the others are their opposites.
NEAR = ((1, 0), (0, 1), (-1, 1))
FAR = ((1, 1), (-1, 2), (-2, 1))


@dataclass(frozen=True)
class Lattice:
    a: float
    row: float
    rows: int
    cols: int


def lattice(grid: Grid) -> Lattice:
    a = min(grid.dx, grid.dy)
    row = a * math.sqrt(3) / 2
    return Lattice(a, row, math.floor((grid.rows - 1) * grid.dy / row) + 1, math.floor((grid.cols - 1) * grid.dx / a))


def first_q(r: Column) -> Column:
    """The first q of a row."""
    return -F.floor(r / 2)


def heights(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """points (key struct, fr, fc), in cells whose values stand at whole numbers, with h; those whose four cells aren't all
    there are dropped."""
    r, c = F.greatest(F.lit(0), F.least(F.lit(grid.rows - 2), F.floor("fr"))), F.greatest(F.lit(0), F.least(F.lit(grid.cols - 2), F.floor("fc")))
    at = points.withColumn("b", r.cast("long") * grid.cols + c.cast("long")).withColumn("tr", F.col("fr") - r).withColumn("tc", F.col("fc") - c)
    four = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).cast("long").alias("d")) for k, d in enumerate((0, 1, grid.cols, grid.cols + 1))])
    held = at.withColumn("x", F.explode(four)).withColumn("i", F.col("b") + F.col("x.d")).join(cells.select("i", F.col("h").cast("double").alias("h")).where("h is not null"), "i")
    pick = [F.max(F.when(F.col("x.k") == k, F.col("h"))) for k in range(4)]
    tr, tc = F.col("tr"), F.col("tc")
    told = held.groupBy("key", "tr", "tc").agg(F.count("*").alias("n"), *[p.alias(f"h{k}") for k, p in enumerate(pick)]).where("n = 4")
    return told.select("key.*", (F.col("h0") * (1 - tr) * (1 - tc) + F.col("h1") * (1 - tr) * tc + F.col("h2") * tr * (1 - tc) + F.col("h3") * tr * tc).alias("h"))


def nodes(cells: DataFrame, grid: Grid) -> DataFrame:
    """(i, q, r, x, y, cell, h)."""
    at = lattice(grid)
    own = cells.sparkSession.range(at.rows * at.cols).select(F.col("id").alias("i"), F.floor(F.col("id") / at.cols).alias("r"), F.pmod("id", F.lit(at.cols)).alias("j")).withColumn("q", first_q(F.col("r")) + F.col("j"))
    placed = own.withColumn("x", at.a * (F.col("q") + F.col("r") / 2)).withColumn("y", F.col("r") * F.lit(at.row)).where((F.col("x") >= 0) & (F.col("x") <= (grid.cols - 1) * grid.dx))
    cr, cc = F.floor(F.col("y") / grid.dy + 0.5), F.floor(F.col("x") / grid.dx + 0.5)
    near = placed.withColumn("cell", cr * grid.cols + cc).where((cr < grid.rows) & (cc < grid.cols))
    open_ = near.join(cells.where("m").select(F.col("i").alias("cell")), "cell", "left_semi")
    return heights(open_.select(F.struct("i", "q", "r", "x", "y", "cell").alias("key"), (F.col("y") / grid.dy).alias("fr"), (F.col("x") / grid.dx).alias("fc")), cells, grid)


def pairs(found: DataFrame, grid: Grid, steps: tuple[tuple[int, int], ...]) -> DataFrame:
    """(u, v, hu, hv, x, y): nodes a step apart, once, and the place between them."""
    at = lattice(grid)
    move = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in steps])).alias("s")
    out = found.select("i", "q", "r", "x", "y", "h", move)
    r = F.col("r") + F.col("s.r")
    j = F.col("q") + F.col("s.q") - first_q(r)
    aimed = out.where((r >= 0) & (r < at.rows) & (j >= 0) & (j < at.cols)).select(F.col("i").alias("u"), F.col("h").alias("hu"), F.col("x").alias("xu"), F.col("y").alias("yu"), (r * at.cols + j).alias("v"))
    ends = found.select(F.col("i").alias("v"), F.col("h").alias("hv"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    return aimed.join(ends, "v").select("u", "v", "hu", "hv", ((F.col("xu") + F.col("xv")) / 2).alias("x"), ((F.col("yu") + F.col("yv")) / 2).alias("y"))


def edges(found: DataFrame, cells: DataFrame, grid: Grid, cost: Cost, twelve: bool = False) -> DataFrame:
    """(u, v, w) over nodes, both ways."""

    def both(there: Column, back: Column) -> Column:
        return F.explode(F.array(F.struct("u", "v", there.alias("w")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), back.alias("w")))).alias("e")

    a, hu, hv, h = F.lit(lattice(grid).a), F.col("hu"), F.col("hv"), F.col("h")
    out = pairs(found, grid, NEAR).select(both(edge_cost(a, hv - hu, cost), edge_cost(a, hu - hv, cost))).select("e.*")
    if not twelve:
        return out
    half = F.lit(lattice(grid).a * math.sqrt(3) / 2)
    middle = heights(pairs(found, grid, FAR).select(F.struct("u", "v", "hu", "hv").alias("key"), (F.col("y") / grid.dy).alias("fr"), (F.col("x") / grid.dx).alias("fc")), cells, grid)
    far = both(edge_cost(half, h - hu, cost) + edge_cost(half, hv - h, cost), edge_cost(half, h - hv, cost) + edge_cost(half, hu - h, cost))
    return out.union(middle.select(far).select("e.*"))


def nearest(found: DataFrame, seeds: DataFrame, grid: Grid) -> DataFrame:
    """Seeds (k, i) on cells as (k, i) on the nearest of the nodes around them (of equals the first); one without any is dropped."""
    own = seeds.select("k", (F.floor(F.col("i") / grid.cols)).alias("sr"), F.pmod("i", F.lit(grid.cols)).alias("sc"))
    step = [F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    around = own.withColumn("s", F.explode(F.array(*step))).withColumn("row", F.col("sr") + F.col("s.r")).withColumn("col", F.col("sc") + F.col("s.c"))
    at = around.where((F.col("row") >= 0) & (F.col("row") < grid.rows) & (F.col("col") >= 0) & (F.col("col") < grid.cols)).withColumn("cell", F.col("row") * grid.cols + F.col("col"))
    x, y = F.col("x") - F.col("sc") * grid.dx, F.col("y") - F.col("sr") * grid.dy
    return at.join(found, "cell").groupBy("k").agg(F.min(F.struct((x * x + y * y).alias("d"), "i")).alias("best")).select("k", "best.i")
