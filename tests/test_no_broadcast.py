"""Large sides that look small to the planner aren't broadcast: a file can be a hundredth of its rows, and what Python makes
is taken to be as large as its input."""

from __future__ import annotations

import pytest
from kelvora.functions.cost import DEFAULT
from kelvora.operators import density, grid, order, search
from kelvora.operators.moves import build_moves


@pytest.fixture(scope="module")
def cells(spark):
    return search.written(spark.range(200).selectExpr("id AS i", "cast(id div 20 AS int) AS r", "cast(id % 20 AS int) AS c", "cast(700 + id % 7 AS float) AS h", "id % 11 != 3 AS m"), "cells")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours(cells):
    near = grid.neighbours(cells, grid.Grid(10, 20), build_moves(8))
    assert "BroadcastHashJoin" not in plan(near) and "SortMergeJoin" in plan(near)
    assert near.count() == sum(1 for r in range(10) for c in range(20) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= r + a < 10 and 0 <= c + b < 20 and (r * 20 + c) % 11 != 3 and ((r + a) * 20 + c + b) % 11 != 3)


def test_matrix(spark, cells):
    edge = grid.edges(cells, grid.Grid(10, 20), DEFAULT, build_moves(8))
    refs = search.written(spark.range(5).selectExpr("id AS k", "id * 2 AS i"), "refs")
    out = density.matrix(search.kernel(edge, refs), refs)
    assert "BroadcastHashJoin" not in plan(out) and out.count() == 25 and out.where("src = dst and e = 0").count() == 5


def test_quantiles(spark):
    values = spark.range(20000).selectExpr("id % 3 AS k", "cast(id div 3 % 40 AS double) AS v")
    own, placed = order._sorted_groups(values, "k", "v")
    out = order._at(own, placed.selectExpr("group", "part", "before", "held", "n", "'x' AS name", "least(n - 1, n div 2) AS at"))
    for branch in plan(out).split("BroadcastExchange")[1:]:
        assert "Window [row_number()" not in branch.split("BroadcastExchange")[0]
    assert {(r.group, r.n, r.value) for r in out.collect()} == {(k, n, float(sorted(x // 3 % 40 for x in range(k, 20000, 3))[n // 2])) for k in range(3) for n in [len(range(k, 20000, 3))]}
    assert order.quantiles(values, "k", "v", {"p": 0.5, "q": 1.0}).where("q = 39").count() == 3
