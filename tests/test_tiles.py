"""Tiled searches against searches of the whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kelvora.functions.cost import DEFAULT
from kelvora.operators import grid, runs, search, tiles
from kelvora.operators.moves import build_moves

G = grid.Grid(60, 45)


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(2)
    rows = [(r * 45 + c, r, c, 700 + 8 * ((r // 7 + c // 5) % 3) + rng.random() * 4, rng.random() > 0.12) for r in range(60) for c in range(45)]
    return search.written(spark.createDataFrame(rows, "i long, r int, c int, h double, m boolean").withColumn("h", F.col("h").cast("float")), "cells")


def rows(df):
    return {(r["k"], r["i"]): r["e"] for r in df.collect()}


@pytest.mark.parametrize(("moves", "size", "e_max"), [(8, 16, 0.0), (16, 7, 3.0)])
def test_grid_in_tiles(spark, cells, moves, size, e_max):
    """Bit for bit; rounds follow the tiles, a searched tile sends no more than its rim."""
    edge = search.written(grid.edges(cells, G, DEFAULT, build_moves(moves)), "edges")
    free = [r.i for r in cells.where("m").orderBy("i").select("i").collect()]
    seeds = spark.createDataFrame([(k, free[k * 97 % len(free)]) for k in range(70)] + [(500, free[0]), (501, 10**6)], "k long, i long")
    tiling = tiles.grid_tiling(G, size)
    assert rows(tiles.field(edge, seeds, tiling, e_max)) == rows(search.kernel(edge, seeds, e_max))
    held = tiles.cut(edge, tiling)
    known, rounds = tiles.offers(held, seeds.limit(1), tiling, e_max)
    sent = known.count()
    across = -(-60 // size) + -(-45 // size)
    assert rounds <= 3 * across and sent < rows(search.kernel(edge, seeds.limit(1), e_max)).__len__()
    assert held.count() <= (-(-60 // size)) * (-(-45 // size)) and "zone" in held.columns


def test_any_graph_in_any_tiles(spark):
    """Nodes dealt to tiles without regard to where they lie, ends without edges, parallel edges, weights of 0."""
    rng = random.Random(3)
    rows_ = [(rng.randrange(200), rng.randrange(260), rng.choice((0.0, 0.25, rng.random()))) for _ in range(900)]
    edge = spark.createDataFrame(rows_, "u long, v long, w double")
    seeds = spark.createDataFrame([(-3, 5), (4, 17), (40, 199), (41, 230)], "k long, i long")
    for tiling in (lambda i: F.pmod(i * 7, F.lit(5)), lambda i: F.floor(i / 30), lambda i: F.lit(0)):
        assert rows(tiles.field(edge, seeds, tiling)) == rows(search.kernel(edge, seeds))
        assert rows(tiles.field(edge, seeds, tiling, 0.3)) == rows(search.kernel(edge, seeds, 0.3))
    assert tiles.field(edge, seeds.limit(0), lambda i: F.floor(i / 30)).count() == 0
    assert rows(tiles.field(edge.limit(0), seeds, lambda i: F.floor(i / 30))) == {(-3, 5): 0.0, (4, 17): 0.0, (40, 199): 0.0, (41, 230): 0.0}


def test_merged_offers(spark, cells, monkeypatch):
    monkeypatch.setattr(tiles, "MERGE", 2)
    monkeypatch.setattr(tiles, "ZONE", 3)
    monkeypatch.setattr(tiles, "NAMED_ZONES", 2)
    edge = search.written(grid.edges(cells, G, DEFAULT, build_moves(8)), "edges")
    seed = cells.where("m").agg(F.min("i").alias("i")).select(F.lit(0).cast("long").alias("k"), "i")
    assert rows(tiles.field(edge, seed, tiles.grid_tiling(G, 15))) == rows(search.kernel(edge, seed))


def test_runs_take_tiles_for_many_edges(spark, cells, monkeypatch):
    """A run gives the same whichever strategy it is carried out by."""
    seed = cells.where("m").agg(F.max("i").alias("i")).select(F.lit(0).cast("long").alias("k"), "i")
    small = runs.raster(runs.Run(e_max=4.0), cells, G, DEFAULT, seed)
    want = rows(small["field"]), {(r["i"]): r["passes"] for r in small["passes"].collect()}
    monkeypatch.setattr(search, "KERNEL_EDGES", 10)
    large = runs.raster(runs.Run(e_max=4.0), cells, G, DEFAULT, seed)
    assert rows(large["field"]) == want[0] and {r["i"]: r["passes"] for r in large["passes"].collect()} == want[1]
