"""Searches and trees by tiles: filled up, and in small ones, against those of the whole."""

from __future__ import annotations

import random

import pytest
from kelvora.functions.cost import DEFAULT
from kelvora.operators import grid, search, tiles, tree
from kelvora.operators.moves import build_moves
from pyspark.sql import functions as F

G = grid.Grid(300, 10)


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(5)
    rows = [(r * 10 + c, r, c, 700 + 8 * ((r // 7 + c // 5) % 3) + rng.random() * 4, rng.random() > 0.12) for r in range(300) for c in range(10)]
    cells = spark.createDataFrame(rows, "i long, r int, c int, h float, m boolean")
    return search.written(grid.edges(cells, G, DEFAULT, build_moves(8)).select("u", "v", "w"), "edges")


@pytest.fixture(scope="module")
def seeds(spark, edge):
    free = sorted(r.u for r in edge.select("u").distinct().collect())
    return spark.createDataFrame([(3, free[0]), (40, free[len(free) // 2]), (41, 10**6)], "k long, i long")


def rows(df, *names):
    return {(r["k"], r["i"]): tuple(r[n] for n in names) for r in df.collect()}


def test_tiles_are_filled(spark, edge, seeds, monkeypatch):
    """A round a tile of the grid's length took 75 rounds; small tiles are searched together."""
    tiling, counted, plain = tiles.grid_tiling(G, 4), [], tiles.offers
    monkeypatch.setattr(tiles, "offers", lambda *a: counted.append(plain(*a)) or counted[-1])
    assert rows(tiles.field(edge, seeds, tiling), "e") == rows(search.kernel(edge, seeds), "e")
    assert counted[0][1] <= 3
    assert tiles.filled(edge, tiling)[1] > 1


def test_trees_by_tiles(edge, seeds, monkeypatch):
    want = search.written(search.kernel(edge, seeds, with_tree=True), "want")
    names = ("e", "parent", "depth", "passes")
    for fill, size, zones in ((10**6, 10**6, 256), (600, 90, 2)):
        monkeypatch.setattr(tiles, "TILE_EDGES", fill)
        monkeypatch.setattr(tiles, "ZONE", zones)
        monkeypatch.setattr(tiles, "SENT", 20)
        tiling = tiles.grid_tiling(G, 5)
        held = search.written(tiles.parents(edge, seeds, tiling), "parents")
        assert rows(held, "parent") == rows(want, "parent")
        assert rows(tiles.passes(held, tiling, size=size), *names) == rows(want, *names)
        few = want.where("i % 7 = 2").select("k", "i")
        assert rows(tiles.passes(held, tiling, few, size), "passes") == rows(tree.passes(want.select("k", "i", "e", "parent"), few), "passes")
        goals = want.groupBy("k").agg(F.max(F.struct("e", "i"))["i"].alias("goal"))
        assert rows(tree.path_to(held, goals, tiling), "goal", "seq", "e") == rows(tree.path(want, goals), "goal", "seq", "e")
    monkeypatch.setattr(search, "KERNEL_EDGES", 10)
    assert rows(search.tree(edge, seeds, 4.0, tiling), *names) == rows(search.kernel(edge, seeds, 4.0, with_tree=True), *names)
    assert rows(search.parents(edge, seeds, 0.0, tiling), "parent") == rows(want, "parent")
