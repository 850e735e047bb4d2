"""Interior points, stopped probes, chains of decks and indicators against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kelvora.functions.cost import DEFAULT
from kelvora.operators import density, grid, network, sampling, search, tiles
from kelvora.operators.components import components
from kelvora.operators.moves import build_moves


def _even_odd(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def _clearance(ring, x, y):
    out = math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        out = min(out, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return out


def test_points_inside_of_any_ring(spark):
    rng = random.Random(1)
    rings = [[(0, 0), (100, 0), (100, 0.001), (0.001, 0.001), (0.001, 100), (0, 100)], [(0, 0), (1, 0), (0, 1)], [(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (7, 1), (7, 9), (6, 9), (6, 1), (0, 1)]]
    for _ in range(60):  # stars, some very thin
        turns = sorted(rng.random() * 2 * math.pi for _ in range(rng.randint(3, 25)))
        if max((b - a) for a, b in zip(turns, turns[1:] + [turns[0] + 2 * math.pi], strict=True)) >= math.pi:
            continue
        squeeze = rng.choice((1.0, 1e-4))
        rings.append([(r * math.cos(t), squeeze * r * math.sin(t)) for t in turns for r in (rng.uniform(0.02, 10),)])
    rings += [r[::-1] for r in rings] + [[(y, x) for x, y in r] for r in rings]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in enumerate(rings)], "d long, ring array<struct<x:double,y:double>>")
    for r in df.select("d", sampling.interior_point(F.col("ring")).alias("p")).collect():
        assert _even_odd(rings[r.d], r.p.x, r.p.y) and _clearance(rings[r.d], r.p.x, r.p.y) > 0, rings[r.d]
    for r in sampling.place_inside(df, tries=2).collect():
        assert _even_odd(rings[r.d], r.x, r.y)
    flat = spark.createDataFrame([(0, [(1.0, 2.0), (5.0, 2.0)])], df.schema)
    assert sampling.place_inside(flat).first()[:] == (0, 1.0, 2.0)


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(4)
    cells = spark.createDataFrame([(r * 30 + c, r, c, 700 + rng.random() * 9, c != 17 or r % 30 == 29) for r in range(45) for c in range(30)], "i long, r int, c int, h double, m boolean")
    return search.written(grid.edges(cells, grid.Grid(45, 30), DEFAULT, build_moves(8)), "edges")


def test_probes_stop(spark, edge, monkeypatch):
    seeds = spark.createDataFrame([(0, 0), (1, 700), (2, 1349), (3, 10**7)], "k long, i long")
    whole: dict = {}
    for r in search.kernel(edge, seeds).collect():
        whole.setdefault(r.k, []).append(r.e)
    for most in (1, 40, 500, 5000):
        want = {k: (min(most, len(e)), sorted(e)[:most][-1]) for k, e in whole.items()}
        assert {r.k: (r.explored, r.reached) for r in search._explored_kernel(edge, seeds, most).collect()} == want
    want = {k: (min(200, len(e)), sorted(e)[:200][-1]) for k, e in whole.items()}
    tiling = tiles.grid_tiling(grid.Grid(45, 30), 16)
    assert {r.k: (r.explored, r.reached) for r in search._explored_by_budget(edge, seeds, 200, tiling).collect()} == want
    net = search.arrays(edge)
    n, _, looked = net.settled(net.number(700), 40)
    assert n == 40 and looked <= 40 * 8 < len(net.weight)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7)]
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.n: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_chains_of_decks(spark):
    """Chains, a ring, a junction and decks alone, on two layers; lines drawn either way."""
    rng = random.Random(6)
    paths = {"chain": [(0, 0), (0, 4), (0, 9), (0, 15)], "two": [(20, 0), (20, 3), (24, 3)], "ring": [(40, 0), (40, 5), (45, 5), (40, 0)], "alone": [(60, 0), (60, 9)]}
    decks, line = {}, 0
    for layer in (1, 2):
        for name, p in paths.items():
            for a, b in zip(p, p[1:], strict=False):
                decks[line] = (layer, name, *((a, b) if rng.random() < 0.5 else (b, a)))
                line += 1
        for far in ((80, 9), (85, 0), (75, 0)):
            decks[line] = (layer, "junction", (80, 0), far)
            line += 1
    vertices = spark.createDataFrame([(k, s, float(x[s + 2][0]), float(x[s + 2][1])) for k, x in decks.items() for s in (0, 1)], "line long, seq long, r double, c double")
    meta = spark.createDataFrame([(k, True, x[0]) for k, x in decks.items()], "line long, deck boolean, layer int")
    height = {k: (rng.uniform(700, 720), rng.uniform(700, 720)) for k in decks}
    length = {k: math.dist(x[2], x[3]) for k, x in decks.items()}
    own = spark.createDataFrame([(k, *height[k], length[k]) for k in decks], "line long, h0 double, h1 double, total double")
    got = {r.line: (r.h0, r.h1) for r in network.chained_decks(vertices, meta, own).collect()}
    want = dict(height)
    for layer in (1, 2):
        for name in ("chain", "two"):
            p = paths[name]
            mine = [next(k for k, x in decks.items() if x[:2] == (layer, name) and {x[2], x[3]} == {a, b}) for a, b in zip(p, p[1:], strict=False)]
            fwd = [decks[k][2] == a for k, a in zip(mine, p, strict=False)]
            low, high = height[mine[0]][0 if fwd[0] else 1], height[mine[-1]][1 if fwd[-1] else 0]
            total, arc = sum(length[k] for k in mine), 0.0
            for k, f in zip(mine, fwd, strict=True):
                ends = low + (high - low) * arc / total, low + (high - low) * (arc + length[k]) / total
                want[k] = ends if f else ends[::-1]
                arc += length[k]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_indicators_make_no_pairs(spark, edge):
    refs = [(k, k * 97 % 1350) for k in range(40)] + [(100, 17), (101, 0)]  # one masked, two on one cell
    ref = spark.createDataFrame(refs, "k long, i long")
    field = search.written(search.kernel(edge, ref.where("k != 100")), "field")
    e = {(r.k, r.i): r.e for r in field.collect()}
    for energy in (0.0, 3.0, 8.0, 50.0):
        n = [sum(e.get((k, i), math.inf) <= energy for _, i in refs) for k, _ in refs]
        assert density.people_within(field, ref, 600.0, 200.0, energy).first()[0] == pytest.approx(sum(x * 600 / 42 >= 200 for x in n) / 42)
        assert density.share_within(field, ref, 0.5, energy / 1.1, 1.1).first()[0] == pytest.approx(sum(x / 42 >= 0.5 for x in n) / 42)
    assert "CartesianProduct" not in (plan := density.people_within(field, ref, 1.0, 1.0, 1.0)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", ["a", "b"])
def test_scrambled_points_stay_one_to_an_interval(spark, seed):
    i = F.col("id")
    rows = spark.range(256).select(i, sampling.scrambled(sampling.sobol_1d(i), f"{seed}1").alias("u"), sampling.scrambled(sampling.sobol_2d(i), f"{seed}2").alias("w"), sampling.sobol_1d(i).alias("plain")).orderBy("id").collect()
    for k in range(9):
        own = rows[: 1 << k]
        for a in range(k + 1):  # every box of 2**-a by 2**-(k - a)
            assert len({(int(r.u * (1 << a)), int(r.w * (1 << (k - a)))) for r in own}) == 1 << k
    assert sum(r.u != r.plain for r in rows) > 250 and all(0 <= r.u < 1 and 0 <= r.w < 1 for r in rows)
