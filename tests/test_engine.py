"""Invariants of fields, trees, routes, rasters, networks, sampling, files and streams."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvora.functions.cost import DEFAULT, derive, edge_cost, edge_cost_of
from kelvora.operators import grid, network, profile, raster, routes, sampling, search, tree
from kelvora.operators.grid import Grid
from kelvora.operators.moves import build_moves, directions
from kelvora.sources import geo
from kelvora.streaming import lifecycle

G = Grid(12, 15)


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(r * 15 + c, r, c, float(700 + 8 * math.sin(r * 0.7) + 5 * math.cos(c * 0.9)), (r * 15 + c) % 29 != 3) for r in range(12) for c in range(15)]
    return spark.createDataFrame(rows, "i long, r int, c int, h float, m boolean").cache()


@pytest.fixture(scope="module")
def edge(cells):
    return grid.edges(cells, G, DEFAULT, build_moves(8)).cache()


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(0, 0), (1, 100), (2, 77)], "k long, i long")


def field(df):
    return {(r.k, r.i): r.e for r in df.collect()}


def test_cost_column_is_the_number(spark):
    rows = [(d, h) for d in (1.0, 30.0, 42.4) for h in (-20.0, -2.0, -0.1, 0.0, 0.3, 5.0)]
    got = spark.createDataFrame(rows, "d double, h double").select("d", "h", edge_cost(F.col("d"), F.col("h"), DEFAULT).alias("w")).collect()
    assert all(r.w == pytest.approx(edge_cost_of(r.d, r.h, DEFAULT), rel=1e-12) for r in got)
    assert derive(k_smooth=0.5).beta == pytest.approx(DEFAULT.beta / 2) and derive(k_smooth=0.5).ab_ratio == DEFAULT.ab_ratio
    assert all(edge_cost_of(30, -x / 10, DEFAULT) > 0 for x in range(1, 500))


def test_moves():
    assert [len(directions(n)) for n in (4, 8, 16, 32, 64, 128)] == [4, 8, 16, 32, 64, 128]
    for n in (16, 32, 64, 128):
        own = directions(n)
        assert own[:8] == directions(8) and len(set(own)) == n and all(math.gcd(*map(abs, v)) == 1 for v in own)
    with pytest.raises(ValueError):
        directions(5)


def test_strategies_agree(edge, seeds):
    a, b = field(search.frontier(edge, seeds)), field(search.kernel(edge, seeds))
    assert a == b and all(a[k, i] == 0 for k, i in ((0, 0), (1, 100), (2, 77))) and min(a.values()) == 0
    capped = field(search.frontier(edge, seeds, 1.5))
    assert capped == {k: v for k, v in a.items() if v <= 1.5} == field(search.kernel(edge, seeds, 1.5))


def test_trees_agree(edge, seeds):
    a = search.tree(edge, seeds).select("k", "i", "e", "parent", "depth", "passes").collect()
    b = tree.tree_of(edge, search.kernel(edge, seeds), seeds).select("k", "i", "e", "parent", "depth", "passes").collect()
    assert sorted(a, key=str) == sorted(b, key=str)
    by = {(r.k, r.i): r for r in a}
    assert by[0, 0].passes == sum(r.k == 0 for r in a)


def test_partitioning_does_not_matter(cells, seeds):
    other = grid.edges(cells.repartition(7, "c"), G, DEFAULT, build_moves(8))
    assert field(search.field(other, seeds)) == field(search.field(grid.edges(cells, G, DEFAULT, build_moves(8)), seeds))


def test_more_directions_never_cost_more(cells, seeds):
    by = [field(search.field(grid.edges(cells, G, DEFAULT, build_moves(n)), seeds)) for n in (4, 8, 16, 32)]
    for coarse, fine in zip(by, by[1:], strict=False):
        assert all(fine[x] <= e + 1e-9 for x, e in coarse.items())


def test_round_and_caps(edge, seeds):
    there, back = search.field(edge, seeds), search.field(grid.reversed_edges(edge), seeds)
    f, b, both = field(there), field(back), field(search.round_trip(there, back))
    assert both == {x: f[x] + b[x] for x in f.keys() & b.keys()}
    assert field(search.round_trip(there, back, 4.0)) == {x: e for x, e in both.items() if e <= 4.0}


def test_portals_are_local(spark, cells, seeds, edge):
    portal = spark.createDataFrame([(0, 170, 50.0, None, None), (5, 5, 1.0, None, None), (3, 9, 1.0, None, None)], "u long, v long, len_m double, hu double, hv double")
    more = grid.edges(cells, G, DEFAULT, build_moves(8), portal)
    assert more.count() == edge.count() + 2  # 5-5 is no edge, 3 is masked
    a, b = field(search.field(edge, seeds)), field(search.field(more, seeds))
    assert b[0, 170] < a[0, 170] and all(b[x] <= a[x] for x in a)


def test_routes(spark, cells, edge):
    for mode in ("per-cell", "linear"):
        out = routes.top_routes(edge, cells, G, DEFAULT, 0, 170, 2, 3.0, mode).collect()
        by = {}
        for r in sorted(out, key=lambda r: (r.route, r.seq)):
            by.setdefault(r.route, []).append(r)
        assert [x[0].i for x in by.values()] == [0, 0] and [x[-1].i for x in by.values()] == [170, 170]
        best = field(search.field(edge, spark.createDataFrame([(0, 0)], "k long, i long")))[0, 170]
        assert by[1][0].energy == pytest.approx(best) and by[2][0].energy >= best - 1e-9 and by[1][0].shared == 0
        assert by[2][0].shared == len({r.i for r in by[1]} & {r.i for r in by[2]})
    pulled = routes.string_pull(spark.createDataFrame([r for r in out if r.route == 1]), cells, G, DEFAULT).orderBy("seq").collect()
    assert pulled[0].energy <= best + 1e-9 and pulled[0].i == 0 and pulled[-1].i == 170


def test_walks(edge, spark):
    seeds = spark.createDataFrame([(0, 0)], "k long, i long")
    steps = {}
    for r in edge.collect():
        steps.setdefault(r.u, []).append((r.v, r.w))
    layer, best = {0: 0.0}, {0: 0.0}
    for _ in range(4):
        new = {}
        for u, e in layer.items():
            for v, w in steps[u]:
                new[v] = max(new.get(v, -1), e + w)
        layer = new
        best = {x: max(best.get(x, -1), layer.get(x, -1)) for x in best.keys() | layer.keys()}
    got = field(routes.dearest_walks(edge, seeds, 4))
    assert {i: pytest.approx(e) for (_, i), e in got.items()} == layer
    assert {i: pytest.approx(e) for (_, i), e in field(routes.dearest_walks(edge, seeds, 4, up_to=True)).items()} == best
    with pytest.raises(ValueError):
        routes.dearest_walks(edge, seeds, 0)


def test_chamfer(cells):
    got = {r.i: r.d for r in raster.chamfer(cells, cells.where("i in (0, 88, 170)"), G).collect()}
    for r in range(12):
        for c in range(15):
            want = min((3 * max(abs(r - a), abs(c - b)) + min(abs(r - a), abs(c - b))) / 3 for a, b in (divmod(x, 15) for x in (0, 88, 170)))
            assert got[r * 15 + c] == pytest.approx(want)
    assert raster.chamfer(cells, cells.limit(0), G).count() == 0


def test_smoothing_keeps_flat_ground(spark):
    flat = spark.createDataFrame([(r * 9 + c, r, c, 5.0, (r + c) % 7 != 0) for r in range(9) for c in range(9)], "i long, r int, c int, h float, m boolean")
    assert {r.h for r in raster.gaussian_smooth(flat, Grid(9, 9), 40.0).collect()} == {5.0}


def test_supercover_and_fill(spark):
    lines = spark.createDataFrame([(0, 0.5, 0.5, 4.5, 2.5), (1, 3.5, 3.5, 3.5, 3.6), (2, 2.5, 4.2, 2.5, 0.2), (3, -3.0, 0.5, 1.5, 0.5)], "poly int, x0 double, y0 double, x1 double, y1 double")
    by = {}
    for r in raster.supercover(lines, Grid(6, 6)).collect():
        by.setdefault(r.poly, set()).add((r.r, r.c))
    assert by[1] == {(3, 3)} and by[2] == {(k, 2) for k in range(5)} and by[3] == {(0, 0), (0, 1)}
    assert len(by[0]) == 4 + 2 + 1 and {(0, 0), (2, 4)} <= by[0]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    sides = [(0, *a, *b) for own in (ring, hole) for a, b in zip(own, own[1:] + own[:1], strict=True)]
    got = {(r.r, r.c) for r in raster.polygon_fill(spark.createDataFrame(sides, "poly int, x0 double, y0 double, x1 double, y1 double"), Grid(6, 6)).collect()}
    assert got == {(r, c) for r in range(4) for c in range(4)} - {(r, c) for r in (1, 2) for c in (1, 2)}


def test_rings(spark):
    ways = [(1, 0, [(0, 0), (4, 0)]), (1, 1, [(0, 4), (4, 4), (4, 0)]), (1, 2, [(0, 4), (0, 0)]), (1, 3, [(9, 9), (8, 8)]), (2, 0, [(0, 0), (1, 0), (1, 1), (0, 0)])]
    df = spark.createDataFrame([(r, w, j, float(x), float(y)) for r, w, own in ways for j, (x, y) in enumerate(own)], "rel long, way long, seq long, x double, y double")
    by = {}
    for r in raster.assemble_rings(df).orderBy("rel", "ring", "seq").collect():
        by.setdefault((r.rel, r.ring), []).append((r.x, r.y))
    assert by == {(1, 0): [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], (2, 0): [(0, 0), (1, 0), (1, 1), (0, 0)]}


def lines_frame(spark, *lines):
    return spark.createDataFrame([(k, j, float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else None) for k, own in enumerate(lines) for j, p in enumerate(own)], "line long, seq long, r double, c double, z double")


def test_planarize(spark):
    x = network.planarize(lines_frame(spark, [(1, 1), (9, 9)], [(1, 9), (9, 1)]))
    assert x[0].count() == 5 and x[1].count() == 4
    t = network.planarize(lines_frame(spark, [(1, 1), (1, 9)], [(1.3, 5), (8, 5)]))
    assert t[1].count() == 3 and t[0].count() == 4
    assert network.planarize(lines_frame(spark, [(1, 1, 0), (9, 9, 0)], [(1, 9, 50), (9, 1, 50)]))[1].count() == 2
    meta = spark.createDataFrame([(0, True, 1), (1, False, 0)], "line long, deck boolean, layer int")
    assert network.planarize(lines_frame(spark, [(1, 1), (9, 9)], [(1, 9), (9, 1)]), meta=meta)[1].count() == 2
    assert network.planarize(lines_frame(spark, [(1, 1), (9, 9)], [(1, 9), (9, 1)]), network.Rules(crossings=False))[1].count() == 2


def test_graph_cost_is_the_grid_step(spark, cells):
    nodes, edges = network.planarize(lines_frame(spark, [(5.5, 2.5), (5.5, 3.5)]))
    cost = network.directed_costs(network.profiles(nodes, edges, cells, G), DEFAULT).first()
    h = {r.i: float(np.float32(r.h)) for r in cells.collect()}
    a, b = 5 * 15 + 2, 5 * 15 + 3
    assert {round(cost.ab, 6), round(cost.ba, 6)} == {round(edge_cost_of(30.0, h[b] - h[a], DEFAULT), 6), round(edge_cost_of(30.0, h[a] - h[b], DEFAULT), 6)}


def test_deck_chain_is_straight(spark, cells):
    v = lines_frame(spark, [(2.5, 2.5), (2.5, 5.5)], [(2.5, 5.5), (2.5, 8.5)], [(6.5, 1.5), (6.5, 3.5)])
    meta = spark.createDataFrame([(0, True, 1, 700.0, None), (1, True, 1, None, 760.0), (2, True, 1, 10.0, 20.0)], "line long, deck boolean, layer int, ele_a double, ele_b double")
    out = {r.line: (r.h0, r.h1) for r in network.chained_decks(v, meta, network.deck_lines(v, meta, cells, G)).collect()}
    assert out[0] == pytest.approx((700.0, 730.0)) and out[1] == pytest.approx((730.0, 760.0)) and out[2] == (10.0, 20.0)


def test_clip_and_place(spark):
    at = lambda *ps: [{"x": x, "y": y} for x, y in ps]
    rows = [("a", 10.0, at((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))), ("b", 8.0, at((10.0, 10.0), (11.0, 10.0), (11.0, 11.0))), ("c", 6.0, at((1.0, 1.0), (2.0, 1.0), (1.0, 2.0)))]
    df = spark.createDataFrame(rows, "cd string, pop double, ring array<struct<x:double,y:double>>")
    got = {r.cd: r.w for r in sampling.clip_weights(df, 0.0, 0.0, 2.0, 2.0).collect()}
    assert got == {"a": pytest.approx(2.5), "c": pytest.approx(6.0)}
    ell = at((0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0))
    picks = spark.createDataFrame([(k, ell) for k in range(40)], "d long, ring array<struct<x:double,y:double>>")
    assert all(p.y <= 1 or p.x <= 1 for p in sampling.place_inside(picks).collect())


def test_profiles(spark):
    flat = spark.createDataFrame([(1, 0, 1000.0, 0.0), (2, 0, 300.0, -30.0), (2, 1, 300.0, -6.0)], "track long, seq long, d double, dh double")
    got = {r.track: r.energy for r in profile.track_energy(flat, DEFAULT).collect()}
    assert got[1] == pytest.approx((DEFAULT.a_roll + DEFAULT.a_aero) * 1000) and 0 < got[2] < got[1]


def test_tiff(spark, tmp_path):
    values = np.arange(48, dtype=np.float32).reshape(6, 8)
    values[2, 3] = -9999
    path = tmp_path / "x.tif"
    path.write_bytes(geo.encode_tiff(values, -46.0, -23.0, 0.001, 0.001, -9999))
    back, head = geo.decode_tiff(path.read_bytes())
    assert (back == values).all() and head["nodata"] == -9999 and head["dx"] == 0.001
    rows = geo.read_geotiff(spark, str(path)).collect()
    assert len(rows) == 48 and [r.i for r in rows if not r.m] == [19]


def test_texts(spark, tmp_path):
    one = spark.createDataFrame([('"a"=>"x","b"=>""', "LINESTRING (1 2, 3.5 -4)"), (None, "POINT (1 2)")], "t string, w string")
    got = one.select(geo.hstore(F.col("t"), "a").alias("a"), geo.hstore(F.col("t"), "b").alias("b"), geo.hstore(F.col("t"), "c").alias("c"), geo.wkt_points(F.col("w")).alias("p")).collect()
    assert got[0].a == "x" and got[0].b == "" and got[0].c is None and [tuple(p) for p in got[0].p] == [(1.0, 2.0), (3.5, -4.0)] and got[1].p is None
    (tmp_path / "f.geojson").write_text('{"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 3}}]}')
    row = geo.read_geojson(spark, str(tmp_path / "f.geojson")).first()
    assert row.kind == "Point" and row.coordinates == "[1,2]" and row.properties == '{"n":3}'
    head, arrays = geo.read_message(geo.frame_message({"n": 1}, np.arange(3, dtype="<f4")))
    assert head == {"n": 1} and arrays[0].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        geo.read_message(geo.frame_message({}, np.arange(3)) + b"x")


def test_lease_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:02:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:30"), (9, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "client long, ts string").select("client", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = lifecycle.lease_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("lease_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    want = {tuple(r) for r in lifecycle.leases(batch).collect() if r.client != 9}
    assert {tuple(r) for r in spark.table("lease_out").collect()} == want and len(want) == 3


def test_entry_without_the_optional_package():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"field_from", "density_passes", "leases"} <= names and set(entry.oracle_sql()) <= names
