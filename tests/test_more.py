"""Files, orders, runs, routes on networks and streams, against plain versions."""

from __future__ import annotations

import heapq
import json
import random
import struct
import zlib

import numpy as np
import pytest
from kelvora.functions.cost import DEFAULT
from kelvora.operators import density, grid, network, order, raster, routes, runs, sampling, search
from kelvora.operators.moves import build_moves
from kelvora.sources import geo
from kelvora.streaming import lifecycle
from pyspark.sql import functions as F


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, wider one early, with a clear at the start and where the table is full."""
    bits, table, width = [], {bytes([k]): k for k in range(256)}, 9
    put = lambda c: bits.append(f"{c:0{width}b}")
    put(256)
    own, n = b"", 258
    for k in range(len(data)):
        if own + data[k : k + 1] in table:
            own += data[k : k + 1]
            continue
        put(table[own])
        table[own + data[k : k + 1]] = n
        n += 1
        if n in (512, 1024, 2048):
            width += 1
        elif n == 4095:
            put(256)
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        own = data[k : k + 1]
    if own:
        put(table[own])
        n += 1
        width += n in (512, 1024, 2048)
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def tiff(values: np.ndarray, packed: int, predictor: int, tile: int | None, big: bool, order_: str) -> bytes:
    h, w = values.shape
    size, blocks = values.itemsize, []
    spots = [(r, c, tile, tile) for r in range(0, h, tile) for c in range(0, w, tile)] if tile else [(r, 0, min(7, h - r), w) for r in range(0, h, 7)]
    for r, c, bh, bw in spots:
        own = np.zeros((bh, bw), values.dtype)
        part = values[r : r + bh, c : c + bw]
        own[: part.shape[0], : part.shape[1]] = part
        if predictor == 2:
            whole = own.view(f"u{size}")
            raw = np.diff(whole, axis=1, prepend=np.zeros((bh, 1), whole.dtype)).astype(whole.dtype).astype(whole.dtype.newbyteorder(order_)).tobytes()
        elif predictor == 3:
            planes = own.astype(own.dtype.newbyteorder(">")).view(np.uint8).reshape(bh, bw, size).transpose(0, 2, 1).reshape(bh, bw * size)
            raw = np.diff(planes, axis=1, prepend=np.zeros((bh, 1), np.uint8)).astype(np.uint8).tobytes()
        else:
            raw = own.astype(own.dtype.newbyteorder(order_)).tobytes()
        blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[packed](raw))
    form = {"f": 3, "u": 1, "i": 2}[values.dtype.kind]
    head = 16 if big else 8
    at = np.cumsum([head, *map(len, blocks)])[:-1].tolist()
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * size]), 259: ("H", [packed]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [form]), 33550: ("d", [2.0, 3.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", at), 325: ("I", [len(b) for b in blocks])} if tile else {273: ("I", at), 278: ("I", [7]), 279: ("I", [len(b) for b in blocks])}
    body, kinds = b"".join(blocks), {"H": 3, "I": 4, "d": 12}
    room, long_ = (8, "Q") if big else (4, "I")
    entries, extra, base = b"", b"", head + len(body)
    for tag, (code, v) in sorted(tags.items()):
        raw = struct.pack(f"{order_}{len(v)}{code}", *v)
        if len(raw) > room:
            raw, extra = struct.pack(order_ + long_, base + len(extra)), extra + raw
        entries += struct.pack(order_ + "HH" + long_, tag, kinds[code], len(v)) + raw.ljust(room, b"\0")
    mark, ifd = b"II" if order_ == "<" else b"MM", base + len(extra)
    first = mark + (struct.pack(order_ + "HHHQ", 43, 8, 0, ifd) if big else struct.pack(order_ + "HI", 42, ifd))
    return first + body + extra + struct.pack(order_ + ("Q" if big else "H"), len(tags)) + entries + b"\0" * room


@pytest.mark.parametrize("packed", [1, 5, 8])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiffs_as_found(packed, predictor, tile):
    rng = np.random.default_rng(packed + predictor)
    for big, order_ in ((False, "<"), (True, "<"), (False, ">")):
        for kind in ("f4", "f8") if predictor == 3 else ("f4", "u1", "i2", "u4"):
            values = (rng.normal(500, 90, (37, 41)).cumsum(1) % 251).astype(kind)
            got, head = geo.decode_tiff(tiff(values, packed, predictor, tile, big, order_))
            assert (got == values).all() and (head["dx"], head["dy"], head["origin_x"], head["origin_y"]) == (2.0, 3.0, 100.0, 200.0)


def test_tiff_that_is_not_read():
    data = tiff(np.zeros((4, 4), "f4"), 1, 1, None, False, "<")
    with pytest.raises(ValueError, match="aren't read"):
        geo.decode_tiff(data.replace(struct.pack("<HHII", 259, 3, 1, 1), struct.pack("<HHII", 259, 3, 1, 7)))


def test_files(spark, tmp_path):
    cells = spark.createDataFrame([(i, float(i)) for i in range(6)], "i long, e double")
    path = geo.raster_grid(cells, str(tmp_path / "e.tif"), 2, 3, "e", origin_x=5.0, origin_y=9.0, dx=1.0, dy=1.0)
    back = geo.read_geotiff(spark, path).orderBy("i").collect()
    assert [r.h for r in back] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and all(r.m for r in back)
    geo.write_bundle({"energy": cells}, {"mode": "from"}, str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle/energy")).count() == 6
    assert json.loads(spark.read.text(str(tmp_path / "bundle/_bundle")).first()[0]) == {"@type": "EnergyFieldBundle", "schemaVersion": 3, "fields": ["energy"], "mode": "from"}
    point = json.loads(geo.to_geojson(spark.createDataFrame([(1.5, 2.5, "a")], "x double, y double, name string")).first()[0])
    assert point["geometry"] == {"type": "Point", "coordinates": [1.5, 2.5]} and point["properties"] == {"name": "a"}
    (tmp_path / "c.csv").write_bytes("CD;v\n001;é\n".encode("latin-1"))
    assert geo.read_census_csv(spark, str(tmp_path / "c.csv")).collect()[0][:] == ("001", "é")
    assert geo.metric(-46.0, -23.0, 0.0003, 0.0003, 0)[1] == pytest.approx(33.1722) and geo.metric(3e5, 7e6, 30.0, 30.0, 9) == (30.0, 30.0)


def test_physics_folds_to_coefficients():
    from kelvora.functions.cost import GRAVITY, derive, flat_speed

    v = flat_speed(100, 80, 0.006, 0.4, 1.2, 0.95)
    assert (0.006 * 80 * GRAVITY + 0.6 * 0.4 * v * v) * v == pytest.approx(95)
    plain, smooth = derive(mass=80, crr=0.006, cda=0.4, rho=1.2, keff=0.95, p_flat=100), derive(mass=80, crr=0.006, cda=0.4, rho=1.2, keff=0.95, p_flat=100, k_smooth=0.5)
    assert (plain.a_roll + plain.a_aero) * 1000 * v == pytest.approx(100)  # on the flat, what is spent is what is held
    assert smooth.beta == plain.beta / 2 and smooth.ab_ratio == plain.ab_ratio == pytest.approx((plain.a_roll + plain.a_aero) / plain.beta)
    assert raster.auto_sigma(5, 5) == 10 and raster.auto_sigma(30, 30) == raster.auto_sigma(5, 5, {"smoothed": "10"}) == 0


def test_orders(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 4), rng.randint(0, 30), rng.randint(1, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g int, at int, n int").repartition(5)
    for r in order.running_sum(df, ["at"], "n", "upto").collect():
        assert r.upto == sum(n for _, a, n in rows if a <= r["at"])
    for r in order.quantiles(df, "g", "at", {"low": 0.1, "half": 0.5, "top": 1.0}).collect():
        v = sorted(a for g, a, _ in rows if g == r.g)
        assert (r.n, r.low, r.half, r.top) == (len(v), v[len(v) // 10], v[len(v) // 2], v[-1])


@pytest.fixture(scope="module")
def ground(spark):
    rows = [(i, i // 12, i % 12, 700.0 + 3 * ((i * 7) % 5), i % 13 != 5) for i in range(120)]
    return spark.createDataFrame(rows, "i long, r int, c int, h float, m boolean"), grid.Grid(10, 12)


def test_runs_and_their_rules(spark, ground):
    cells, own = ground
    seeds = spark.createDataFrame([(0, 0)], "k long, i long")
    assert runs.Run(maximize=True, e_max=9.0, directions=16).settled() == runs.Run(maximize=True)
    for bad in (runs.Run(directions=9), runs.Run(mode="up"), runs.Run(walk_edges=3)):
        with pytest.raises(ValueError):
            bad.settled()
    out = runs.raster(runs.Run(mode="to"), cells, own, DEFAULT, seeds, 118)
    edge = search.written(grid.edges(cells, own, DEFAULT, build_moves(8, own.dx, own.dy)), "e")
    want = {r.i: r.e for r in search.field(grid.reversed_edges(edge), seeds).collect()}
    assert {r.i: r.e for r in out["field"].collect()} == want and {r.i for r in out["route"].collect()} >= {0, 118}
    capped = runs.raster(runs.Run(mode="round", e_max=2.0, total=True), cells, own, DEFAULT, seeds)["field"].collect()
    there = {r.i: r.e for r in search.field(edge, seeds, 2.0).collect()}
    assert {r.i: r.e for r in capped} == {i: there[i] + want[i] for i in there if i in want and there[i] + want[i] <= 2.0}
    both = [spark.createDataFrame([(1, 2.0, 3.0, 1)], "i long, passes double, energy_sum double, n long")] * 2
    assert density.merged(*both).first()[:] == (1, 4.0, 6.0, 2)


def test_walk_states(spark, ground):
    cells, own = ground
    edge = search.written(grid.edges(cells, own, DEFAULT, build_moves(8, own.dx, own.dy)), "e")
    state = lambda *a, **k: routes.dearest_walk(edge, *a, **k)[1].first()[0]
    assert [state(0, 0), state(0, 5001), state(5, 3, 0), state(0, 3, 5), state(0, 2, 118), state(0, 2, 2)] == ["bad_L", "bad_L", "oob", "oob", "unreachable", "ok"]
    walk = routes.dearest_walk(edge, 0, 6, 3)[0].orderBy("seq").collect()
    costs = {(r.u, r.v): r.w for r in edge.collect()}
    assert walk[0].i == 0 and walk[-1].i == 3 and sum(costs[a.i, b.i] for a, b in zip(walk, walk[1:], strict=False)) == pytest.approx(walk[-1].e)
    best = {r.i: r.e for r in routes.dearest_walks(edge, spark.createDataFrame([(0, 0)], "k long, i long"), 6).collect()}
    assert walk[-1].e == pytest.approx(best[3])


def cheapest(costs: dict, seed: int) -> tuple[dict, dict]:
    out: dict = {}
    for (u, v), w in costs.items():
        out.setdefault(u, []).append((v, w))
    best, up, todo = {seed: 0.0}, {}, [(0.0, seed)]
    while todo:
        e, u = heapq.heappop(todo)
        if e > best[u]:
            continue
        for v, w in out.get(u, ()):
            if e + w < best.get(v, float("inf")):
                best[v], up[v] = e + w, u
                heapq.heappush(todo, (e + w, v))
    return best, up


def test_routes_on_a_network(spark):
    """Against one search after another in plain Python, on random networks without ties."""
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)})
    rows = [(a, b, rng.uniform(50, 90), rng.uniform(1, 3), rng.uniform(1, 3)) for a, b in pairs]
    costs = spark.createDataFrame(rows, "a long, b long, len_m double, ab double, ba double")
    valid = spark.createDataFrame([(i,) for i in range(30)], "n long")
    half = search.written(network.half_edges(costs, valid), "half")
    for turned in (False, True):
        got: dict = {}
        for r in network.top_routes(grid.reversed_edges(half) if turned else half, costs, 0, 29, 4, 3.0, DEFAULT).orderBy("route", "seq").collect():
            got.setdefault(r.route, (r.energy, r.length_m, r.shared_edges, []))[3].append(r.i)
        own = {(b, a) if turned else (a, b): w for a, b, _, w, _ in rows} | {(a, b) if turned else (b, a): w for a, b, _, _, w in rows}
        length, used, found = {frozenset((a, b)): m for a, b, m, *_ in rows}, {}, []
        for _ in range(4):
            now = {(u, v): w + (3.0 ** used.get(frozenset((u, v)), 0) - 1) * (DEFAULT.a_roll + DEFAULT.a_aero) * length[frozenset((u, v))] for (u, v), w in own.items()}
            _, up = cheapest(now, 0)
            way = [29]
            while way[-1] != 0:
                way.append(up[way[-1]])
            found.append(way[::-1])
            for a, b in zip(way, way[1:], strict=False):
                used[frozenset((a, b))] = used.get(frozenset((a, b)), 0) + 1
        for k, way in enumerate(found, 1):
            steps = list(zip(way, way[1:], strict=False))
            energy, m, shared, nodes = got[k]
            assert nodes == way and energy == pytest.approx(sum(own[x] for x in steps)) and m == pytest.approx(sum(length[frozenset(x)] for x in steps))
            assert shared == sum(used[frozenset(x)] > 1 for x in steps)
    path = network.best_path(half, costs, 0, 29).orderBy("seq").collect()
    assert path[0].energy == pytest.approx(cheapest({(a, b): w for a, b, _, w, _ in rows} | {(b, a): w for a, b, _, _, w in rows}, 0)[0][29])


def test_goal_directed_route(spark, ground):
    cells, own = ground
    edge = search.written(grid.edges(cells, own, DEFAULT, build_moves(8, own.dx, own.dy)), "e")
    want = {r.i: r.e for r in search.field(edge, spark.createDataFrame([(0, 0)], "k long, i long")).collect()}
    route = search.best_route(edge, routes.least_left(cells, own, DEFAULT, 118), 0, 118).orderBy("seq").collect()
    assert route[0].i == 0 and route[-1].i == 118 and route[-1].e == want[118]
    bound = {r.i: r.left for r in routes.least_left(cells, own, DEFAULT, 0, reverse=True).collect()}
    assert all(bound[i] <= e + 1e-9 for i, e in want.items())
    assert search.best_route(edge, routes.least_left(cells, own, DEFAULT, 118), 0, 5).count() == 0


def test_frontier_and_kernel_agree(spark, ground):
    cells, own = ground
    edge = search.written(grid.edges(cells, own, DEFAULT, build_moves(16, own.dx, own.dy)), "e")
    seeds = spark.createDataFrame([(0, 0), (1, 61)], "k long, i long")
    assert sorted(search.frontier(edge, seeds).collect()) == sorted(search.kernel(edge, seeds).collect())


def test_spread_and_nearest(spark, ground):
    cells, own = ground
    got = sampling.spread(cells, own, 5).collect()
    open_ = {r.i for r in cells.where("m").collect()}
    assert len(got) == 5 and all(r.i in open_ for r in got)
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0e7)], "n long, r double, c double")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0e8, 5.0e8), (2, None, 1.0), (3, float("nan"), 0.0)], "p long, r double, c double")
    assert {r.p: r.n for r in network.nearest(points, nodes).collect()} == {0: 1, 1: 2}
    assert network.nearest(points, nodes.limit(0)).count() == 0


def test_rings_join_across_rounding(spark):
    """Ends that are nearer than the tolerance join, wherever they lie."""
    e = 0.4e-7
    ways = [(1, 1, [(0.5e-7 - e / 2, 0.0), (1.0, 0.0), (1.0, 1.0)]), (1, 2, [(1.0, 1.0 + e), (0.0, 1.0), (0.5e-7 + e / 2, 0.0)]), (1, 3, [(5.0, 5.0), (6.0, 6.0)])]
    rows = [(rel, w, j, x, y) for rel, w, p in ways for j, (x, y) in enumerate(p)]
    got = raster.assemble_rings(spark.createDataFrame(rows, "rel long, way long, seq int, x double, y double")).orderBy("seq").collect()
    assert {r.ring for r in got} == {0} and len(got) == 5


def test_streams_and_states(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(0, 3), i, rng.uniform(1, 9), rng.uniform(1, 9)) for i in range(400)]
    schema = "client long, seq long, actual double, predicted double"
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[1] * 3 // 400 == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    want = {}
    for c, _, a, p in rows:
        want[c] = min(5.0, max(0.2, 0.5 * want.get(c, 1.0) + 0.5 * min(5.0, max(0.2, a / p))))
    assert {r.client: r.corr for r in lifecycle.ema(spark.createDataFrame(rows, schema)).collect()} == pytest.approx(want)
    stream = lifecycle.ema_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
    done = stream.writeStream.format("memory").queryName("ema").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert {r.client: r.corr for r in spark.table("ema").collect()} == pytest.approx(want)
    states = spark.createDataFrame([("ABSENT",), ("STOPPED",), ("STARTING",), ("RUNNING",), ("?",)], "s string")
    assert [r[0] for r in states.select(lifecycle.eta_s(F.col("s"))).collect()] == [240, 60, 30, 0, None]
