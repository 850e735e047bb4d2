"""Lines of fewer vertices, multiple forms, the lattice of hexagons, percentiles and means against plain versions."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from kelvora.functions.cost import DEFAULT, edge_cost_of
from kelvora.operators import hexagonal, raster, search, simplify
from kelvora.operators.grid import Grid

VERTEX = "line long, seq long, r double, c double"
CELL = "i long, r int, c int, h double, m boolean"


def _plain(line, tol):
    """Kept vertices (seq, r, c) of one line, by recursion."""

    def far(p, a, b):
        dr, dc = b[1] - a[1], b[2] - a[2]
        n = dr * dr + dc * dc
        t = max(0.0, min(1.0, ((p[1] - a[1]) * dr + (p[2] - a[2]) * dc) / n)) if n > 0 else 0.0
        x, y = p[1] - (a[1] + t * dr), p[2] - (a[2] + t * dc)
        return x * x + y * y

    def between(a, b):
        if b - a < 2:
            return []
        d, _, at = max((far(line[k], line[a], line[b]), -abs(2 * line[k][0] - line[a][0] - line[b][0]), -k) for k in range(a + 1, b))
        return [*between(a, -at), -at, *between(-at, b)] if d > tol * tol else []

    line = sorted(line)
    ends = [0, len(line) - 1] if len(line) > 1 else [0]
    kept = sorted([*ends, *between(0, len(line) - 1)])
    closed = len(line) > 1 and line[0][1:] == line[-1][1:]
    return line if closed and len(kept) < 4 else [line[k] for k in kept]


def _lines():
    rng = random.Random(5)
    out = {}
    for line in range(40):
        r = c = 0.0
        own = []
        for seq in range(rng.choice([1, 2, 3, 9, 60])):
            r, c = r + rng.choice([-0.5, 0.0, 0.25, 1.0]), c + rng.choice([-0.25, 0.0, 0.5, 1.0])
            own.append((seq * 3, r, c))
        out[line] = own
    out[100] = [(k, math.sin(k / 25) * 8 + rng.random(), k / 16) for k in range(1500)]
    out[101] = [(k, math.cos(k / 50) * k / 100, math.sin(k / 50) * k / 100) for k in range(900)]
    out[102] = [(k, 0.0, float(k % 2)) for k in range(700)]  # ties
    out[103] = [(k, float(k) * 2, 1.0) for k in range(400)]  # straight, longer than a part
    ring = [(math.cos(k * math.pi / 60), math.sin(k * math.pi / 60)) for k in range(120)]
    out[104] = [(k, *p) for k, p in enumerate([*ring, ring[0]])]
    out[105] = [(k, p[0] / 50, p[1] / 50) for k, p in enumerate([*ring, ring[0]])]  # a ring below tol
    return out


@pytest.mark.parametrize(("piece", "tols"), [(90, (0.4,)), (simplify.PIECE, (0.0, 0.4, 3.0))])
def test_lines_equal_the_plain_recursion(spark, piece, tols):
    lines = _lines()
    rows = [(line, *v) for line, own in lines.items() for v in own]
    random.Random(1).shuffle(rows)
    for tol in tols:
        got = sorted(tuple(r) for r in simplify.simplify(spark.createDataFrame(rows, VERTEX), tol, piece).collect())
        assert got == sorted((line, *v) for line, own in lines.items() for v in _plain(own, tol))


def test_parts_are_never_longer_than_a_piece(spark):
    rows = [(line, *v) for line, own in _lines().items() for v in own]
    cut = simplify.parts(spark.createDataFrame(rows, VERTEX), 0.1, 90)
    assert cut.groupBy("line", "at").count().agg(F.max("count")).first()[0] <= 92
    assert cut.where("not again").count() < len(rows)  # what a straight part leaves out
    assert cut.where("not again").groupBy("line", "seq").count().where("count > 1").count() == 0


def test_defined_results_of_lines(spark):
    odd = [(1, 0, 0.0, 0.0), (1, 1, None, 5.0), (1, 2, float("nan"), 5.0), (1, 3, 0.0, 9.0), (None, 0, 1.0, 1.0), (2, 0, 4.0, 4.0), (3, None, 1.0, 1.0)]
    df = spark.createDataFrame(odd, VERTEX).withColumn("at", F.lit("x")).withColumn("again", F.lit(1))
    assert sorted(tuple(r) for r in simplify.simplify(df, 0.1).collect()) == [(1, 0, 0.0, 0.0), (1, 3, 0.0, 9.0), (2, 0, 4.0, 4.0)]
    assert simplify.simplify(spark.createDataFrame([], VERTEX), 0.1).collect() == []


def test_multiple_forms(spark):
    cases = {
        "POLYGON ((0 0, 1 0, 1 1, 0 0), (2 2, 3 3, 2 3, 2 2))": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (2 2, 3 3, 2 3, 2 2)))",
        " linestring(0 0, 1 1) ": "MULTILINESTRING ((0 0, 1 1))",
        "Point Z (1 2 3)": "MULTIPOINT Z ((1 2 3))",
        "POLYGON EMPTY": "MULTIPOLYGON EMPTY",
        "MULTIPOINT ((1 2))": "MULTIPOINT ((1 2))",
        "GEOMETRYCOLLECTION EMPTY": "GEOMETRYCOLLECTION EMPTY",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.m for r in df.select("t", simplify.promote_to_multi(F.col("t")).alias("m")).collect()} == cases


def _ground(spark, rows=14, cols=11):
    rng = random.Random(3)
    cells = [(r * cols + c, r, c, round(20 * math.sin(r / 3) + 10 * math.cos(c / 2) + rng.random(), 3), rng.random() > 0.08) for r in range(rows) for c in range(cols)]
    return cells, spark.createDataFrame(cells, CELL)


@pytest.mark.parametrize("twelve", [False, True])
def test_hexagons_equal_a_plain_search(spark, twelve):
    grid = Grid(14, 11, 30.0, 25.0)
    cells, df = _ground(spark)
    h, m = {(r, c): x for _, r, c, x, _ in cells}, {(r, c) for _, r, c, _, ok in cells if ok}
    a = 25.0

    def level(x, y):
        fr, fc = y / grid.dy, x / grid.dx
        r, c = max(0, min(grid.rows - 2, math.floor(fr))), max(0, min(grid.cols - 2, math.floor(fc)))
        return h[r, c] * (1 - fr + r) * (1 - fc + c) + h[r, c + 1] * (1 - fr + r) * (fc - c) + h[r + 1, c] * (fr - r) * (1 - fc + c) + h[r + 1, c + 1] * (fr - r) * (fc - c)

    wide, high = math.floor((grid.cols - 1) * grid.dx / a), math.floor((grid.rows - 1) * grid.dy / (a * math.sqrt(3) / 2)) + 1
    at, number = {}, {}
    for r in range(high):
        for j in range(wide):
            q = j - r // 2
            x, y = a * (q + r / 2), a * math.sqrt(3) / 2 * r
            if x <= (grid.cols - 1) * grid.dx and (math.floor(y / grid.dy + 0.5), math.floor(x / grid.dx + 0.5)) in m:
                at[q, r], number[q, r] = (x, y), r * wide + j
    found = search.written(hexagonal.nodes(df, grid), "hexagons")
    assert {r.i: (r.q, r.r) for r in found.collect()} == {i: k for k, i in number.items()}
    first = min(i for i, _, _, _, ok in cells if ok)
    sr, sc = divmod(first, grid.cols)
    begin = min(at, key=lambda k: ((at[k][0] - sc * grid.dx) ** 2 + (at[k][1] - sr * grid.dy) ** 2, number[k]))
    steps = [(s * q, s * r, 1) for s in (1, -1) for q, r in hexagonal.NEAR] + [(s * q, s * r, 2) for s in (1, -1) for q, r in hexagonal.FAR if twelve]
    want, heap = {}, [(0.0, begin)]
    while heap:
        e, k = heapq.heappop(heap)
        if k in want:
            continue
        want[k] = e
        for dq, dr, halves in steps:
            n = (k[0] + dq, k[1] + dr)
            if n in at:
                own, to = level(*at[k]), level(*at[n])
                mid = level((at[k][0] + at[n][0]) / 2, (at[k][1] + at[n][1]) / 2)
                half = a * math.sqrt(3) / 2
                cost = edge_cost_of(a, to - own, DEFAULT) if halves == 1 else edge_cost_of(half, mid - own, DEFAULT) + edge_cost_of(half, to - mid, DEFAULT)
                heapq.heappush(heap, (e + cost, n))
    seeds = hexagonal.nearest(found, spark.createDataFrame([(0, first)], "k long, i long"), grid)
    got = {r.i: r.e for r in search.field(hexagonal.edges(found, df, grid, DEFAULT, twelve), seeds).collect()}
    assert got.keys() == {number[k] for k in want}
    assert all(abs(got[number[k]] - e) < 1e-9 for k, e in want.items())


def test_percentiles_and_means(spark):
    cells, df = _ground(spark)
    held = sorted(h for *_, h, ok in cells if ok)
    row = raster.percentiles(df, (0.1, 0.5, 0.9)).first()
    assert (row.n, row.p10, row.p50, row.p90) == (len(held), *(held[int(s * len(held))] for s in (0.1, 0.5, 0.9)))
    got = {r.i: r.h for r in raster.mean_filter(df, 2).collect()}
    for i, r, c, _, ok in cells:
        near = [x for _, a, b, x, k in cells if k and abs(a - r) <= 2 and abs(b - c) <= 2]
        assert (i in got) == ok
        assert not ok or abs(got[i] - sum(near) / len(near)) < 1e-9
    assert raster.percentiles(df.where("false")).collect() == []
