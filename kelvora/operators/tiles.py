"""Least-cost fields on one very large grid or network, tile by tile.

A tile holds the edges that leave its nodes as arrays, and is searched whole inside a task. What crosses its rim is an offer:
the cost at which a node of another tile is reached. A round wakes the tiles that have had a better offer, searches them from
the best of all their offers, and sends on what is better than any offer known there; when there is none, every tile that was
reached is searched once more, and gives its nodes' costs. So only offers for nodes along rims are ever written, rounds
grow with the tiles that a path crosses and not with its hops, and no tile that isn't woken is read beyond its zone.

Small tiles that follow each other are searched as one, of about ``TILE_EDGES`` edges, so rounds don't grow where tiles are
named finer than a task needs. Trees are summed up by tiles as well: a tile is folded to the nodes that ways leave and enter
it by, sums double over these few, and each tile is unfolded with what comes in.

Costs are the least left-to-right sums over all paths, bit for bit those of ``search.kernel`` and ``search.frontier``.
A tile's edges have to fit a task: on a grid that is its cells times the moves. Any number of seeds is searched at once, a
tile being taken for so many of them at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.operators.grid import Grid
from kelvora.operators.search import Arrays, _shared, written

#: From a node to the number of its tile.
Tiling = Callable[[Column], Column]
SIZE = 64
#: Tiles are stored by zones of so many, and a round that wakes at most so many zones reads no other.
ZONE, NAMED_ZONES = 256, 1000
#: Seeds that a tile is searched for in one row, and rounds after which what is known is merged.
SEEDS, MERGE = 32, 8
#: Edges that a tile is filled up to, and offers that are sent to where the tiles lie instead of moving tiles.
TILE_EDGES, SENT = 1_000_000, 200_000
_OFFER = "k bigint, tile bigint, i bigint, e double"
_HELD = "ids array<bigint>, head array<int>, target array<int>, weight array<double>, foreign array<int>, foreign_tile array<bigint>"


def grid_tiling(grid: Grid, size: int = SIZE) -> Tiling:
    """Squares of cells, numbered along rows of squares."""
    across = -(-grid.cols // size)
    return lambda i: F.floor(F.floor(i / grid.cols) / size) * across + F.floor(F.pmod(i, F.lit(grid.cols)) / size)


def filled(edge: DataFrame, tile: Tiling) -> tuple[Tiling, int]:
    """(tiles of about TILE_EDGES edges, how many of the named ones each takes) for edges that are written."""
    n, tiles = edge.agg(F.count("*"), F.count_distinct(tile(F.col("u")))).first()
    many = max(1, TILE_EDGES * tiles // max(1, n))
    return (lambda i: F.floor(tile(i) / many)) if many > 1 else tile, many


def cut(edge: DataFrame, tile: Tiling, zone: int = 0) -> DataFrame:
    """(zone, tile, arrays) of edges (u, v, w): written once, a folder a zone of so many tiles."""
    zone = zone or ZONE

    def build(rows: pa.Table) -> pa.Table:
        u, v, w, other = (rows.column(c).to_numpy() for c in ("u", "v", "w", "other"))
        number = rows.column("tile")[0].as_py()
        held = Arrays(u, v, w)
        far = np.flatnonzero(other != number)
        foreign, first = np.unique(np.searchsorted(held.ids, v[far]), return_index=True)
        columns = [held.ids, held.head.astype(np.int32), held.target.astype(np.int32), held.weight, foreign.astype(np.int32), other[far][first]]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in columns]
        return pa.Table.from_arrays([pa.array([number // zone]), pa.array([number]), *lists], names=["zone", "tile", *(f.split()[0] for f in _HELD.split(", "))])

    own = edge.select(tile(F.col("u")).cast("long").alias("tile"), "u", "v", F.col("w").cast("double").alias("w"), tile(F.col("v")).cast("long").alias("other"))
    made = own.groupBy("tile").applyInArrow(build, f"zone bigint, tile bigint, {_HELD}")
    path = f"{_shared(edge.sparkSession)}/tiles-{uuid.uuid4().hex}"
    made.write.partitionBy("zone").parquet(path)
    return edge.sparkSession.read.schema(f"tile bigint, {_HELD}, zone bigint").parquet(path)


def _search(offers: pa.Array, arrays: list[pa.Array], e_max: float) -> Iterator[tuple[int, Arrays, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, edges, costs, foreign, tiles of foreign, offered ids that no edge names) for each seed that has offers to a tile."""
    ids, head, target, weight, foreign, foreign_tile = (x.to_numpy(zero_copy_only=False) for x in arrays)
    net = Arrays.of(ids, head.astype(np.int64), target.astype(np.int64), weight)
    ks, nodes, costs = (offers.field(c).to_numpy(zero_copy_only=False) for c in ("k", "i", "e"))
    order = np.argsort(ks, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(ks[order])) + 1):
        at = np.searchsorted(ids, nodes[own])
        known = at < len(ids)
        known[known] = ids[at[known]] == nodes[own][known]
        best = np.full(len(ids), np.inf)
        np.minimum.at(best, at[known], costs[own][known])
        net.spread(best, np.unique(at[known]), e_max)
        yield int(ks[own[0]]), net, best, foreign, foreign_tile, own[~known]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def offers(tiles: DataFrame, seeds: DataFrame, tile: Tiling, e_max: float = 0.0, zone: int = 0) -> tuple[DataFrame, int]:
    """(the best offers (k, tile, i, e) to all tiles, the number of rounds)."""
    zone = zone or ZONE

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = []
                for k, net, best, foreign, tile_of, _ in _search(batch.column(0)[row].values, [c[row].values for c in batch.columns[1:]], e_max):
                    fine = np.flatnonzero(best[foreign] < np.inf)
                    out.append((np.full(len(fine), k), tile_of[fine], net.ids[foreign[fine]], best[foreign[fine]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["k", "tile", "i", "e"])

    def zones(df: DataFrame) -> tuple[list[int], int]:
        """(zones, how many offers): more zones than are named count as any number of offers."""
        found = df.groupBy(F.floor(F.col("tile") / zone).alias("zone")).count().limit(NAMED_ZONES + 1).collect()
        return [r["zone"] for r in found], sum(r["count"] for r in found) if len(found) <= NAMED_ZONES else SENT + 1

    key = ["k", "tile", "i"]
    begun = seeds.select(F.col("k").cast("long").alias("k"), tile(F.col("i")).cast("long").alias("tile"), F.col("i").cast("long").alias("i"), F.lit(0.0).alias("e")).distinct()
    held, rounds = [written(begun, "offers")], 0
    named, many = zones(held[0])
    while named:
        new, rounds = held[-1], rounds + 1
        known = _union(held).groupBy(*key).agg(F.min("e").alias("e"))
        woken = known.join(new.select("k", "tile").distinct(), ["k", "tile"], "left_semi")
        own = tiles.where(F.col("zone").isin(named)) if len(named) <= NAMED_ZONES else tiles
        asked = gathered(woken)
        sent = (F.broadcast(asked) if many <= SENT else asked).join(own, "tile").select("offers", *(f.split()[0] for f in _HELD.split(", "))).mapInArrow(send, _OFFER)
        best = sent.groupBy(*key).agg(F.min("e").alias("e"))
        better = best.join(known.withColumnRenamed("e", "known"), key, "left").where("known is null or e < known").select(*key, "e")
        after = written(better, "offers")
        named, more = zones(after)
        many, held = many + more, [*held, after]
        if named and len(held) > MERGE:
            held = [written(_union(held).groupBy(*key).agg(F.min("e").alias("e")), "offers"), after]
    return _union(held).groupBy(*key).agg(F.min("e").alias("e")), rounds


def gathered(known: DataFrame) -> DataFrame:
    """(tile, offers): a tile's offers for some seeds a row. The part is drawn from the seed's number."""
    return known.groupBy("tile", F.floor(F.col("k") / SEEDS).alias("part")).agg(F.collect_list(F.struct("k", "i", "e")).alias("offers")).drop("part")


def field(edge: DataFrame, seeds: DataFrame, tile: Tiling, e_max: float = 0.0, ready: bool = False) -> DataFrame:
    """(k, i, e) from seeds (k, i): as ``search.frontier``, with a budget of 0 for none. Edges that are a table are ready."""
    return _costs(edge, seeds, tile, e_max, False, ready).select("k", "i", "e").hint("merge")


def parents(edge: DataFrame, seeds: DataFrame, tile: Tiling, e_max: float = 0.0, ready: bool = False) -> DataFrame:
    """(k, i, e, parent), as ``tree.parents``: a tile tells the best way to each of its nodes and to those beyond its rim."""
    told = _costs(edge, seeds, tile, e_max, True, ready)
    best = told.groupBy("k", "i").agg(F.max("e").alias("e"), F.min(F.when(F.col("u").isNotNull(), F.struct("cost", "u")))["u"].alias("parent")).where("e is not null")
    seed = seeds.select("k", "i", F.lit(True).alias("seed")).distinct()
    return best.join(seed, ["k", "i"], "left").select("k", "i", "e", F.when(F.col("seed").isNull(), F.col("parent")).alias("parent"))


def _costs(edge: DataFrame, seeds: DataFrame, tile: Tiling, e_max: float, ways: bool, ready: bool) -> DataFrame:
    """(k, i, e, cost, u): the costs of a tile's nodes, and for ways the node u through which a tile's own or foreign node is
    cheapest by the tile's edges. e is null where only a way is told."""

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                given = batch.column(0)[row].values
                if not batch.column(1)[row].is_valid:  # no edge leaves this tile
                    yield _told(given.field("k"), given.field("i"), given.field("e"))
                    continue
                for k, net, best, foreign, _, alone in _search(given, [c[row].values for c in batch.columns[1:]], e_max):
                    here = best < np.inf
                    here[foreign] = False
                    lone = pa.array(alone)
                    yield _told(pa.array(np.full(len(alone), k)), given.field("i").take(lone), given.field("e").take(lone))
                    cost, u = net.ways(best) if ways else (None, None)
                    rows = np.flatnonzero(here if not ways else here | (cost < np.inf))
                    e = pa.array(best[rows], mask=~here[rows])
                    yield _told(pa.array(np.full(len(rows), k)), pa.array(net.ids[rows]), e, *([pa.array(cost[rows]), pa.array(u[rows], mask=~(cost[rows] < np.inf))] if ways else []))

    held = edge if ready else written(edge.select("u", "v", "w"), "edges")
    tile, many = filled(held, tile)
    zone = max(1, ZONE // many)
    tiles = cut(held, tile, zone)
    known = written(offers(tiles, seeds, tile, e_max, zone)[0], "known")
    return gathered(known).join(tiles.hint("merge"), "tile", "left").select("offers", *(f.split()[0] for f in _HELD.split(", "))).mapInArrow(costs, "k bigint, i bigint, e double, cost double, u bigint")


def _told(k: pa.Array, i: pa.Array, e: pa.Array, cost: pa.Array | None = None, u: pa.Array | None = None) -> pa.RecordBatch:
    cost = pa.nulls(len(k), pa.float64()) if cost is None else cost
    u = pa.nulls(len(k), pa.int64()) if u is None else u
    return pa.RecordBatch.from_arrays([k, i, e, cost, u], ["k", "i", "e", "cost", "u"])


class _Part:
    """A tile's part of a tree: nodes by number, with the way up inside of it."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("i").to_numpy())
        self.rows = rows.take(pa.array(order))
        self.i = self.rows.column("i").to_numpy()
        up = self.rows.column("parent").fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(self.i, up), len(self.i) - 1)
        inner = (self.i[at] == up) & self.rows.column("parent").is_valid().to_numpy()
        self.up = np.where(inner, at, np.arange(len(self.i)))
        self.root, self.depth = self.up.copy(), inner.astype(np.int64)
        while True:
            more = self.depth[self.root]
            if not more.any():
                break
            self.depth, self.root = self.depth + more, self.root[self.root]

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Of each node's subtree inside of the tile."""
        out, order = weight.astype(float), np.argsort(self.depth, kind="stable")
        heads = np.searchsorted(self.depth[order], np.arange(int(self.depth.max(initial=0)) + 2))
        for d in range(len(heads) - 2, 0, -1):
            own = order[heads[d] : heads[d + 1]]
            np.add.at(out, self.up[own], out[own])
        return out


def passes(tree: DataFrame, tile: Tiling, include: DataFrame | None = None, size: int = TILE_EDGES // 8) -> DataFrame:
    """``tree.passes`` of a written tree (k, i, e, parent) by tiles of about ``size`` nodes."""
    n, named = tree.agg(F.count("*"), F.count_distinct("k", tile(F.col("i")))).first()
    many = max(1, size * named // max(1, n))
    at = lambda c: F.floor(tile(F.col(c)) / many).cast("long")
    own = tree.select("k", "i", "e", "parent", at("i").alias("tile"), at("parent").alias("above"), F.lit(1.0).alias("weight"))
    if include is not None:
        flags = include.select("k", "i", F.lit(1.0).alias("flag")).distinct()
        own = own.join(flags, ["k", "i"], "left").withColumn("weight", F.coalesce("flag", F.lit(0.0))).drop("flag")
    own = written(own, "parts")
    ports = own.where("above != tile").select("k", F.col("parent").alias("i"), F.lit(True).alias("port")).distinct()

    def fold(rows: pa.Table) -> pa.Table:
        """Ports' ways out (i to anc, real steps; a port below the whole tree's root stays), and what goes up by each way out."""
        part = _Part(rows)
        sums, parent = part.sums(part.rows.column("weight").to_numpy()), part.rows.column("parent")
        out = parent.fill_null(0).to_numpy()[part.root]
        top = ~parent.is_valid().to_numpy()[part.root]
        p = np.flatnonzero(part.rows.column("port").fill_null(False).to_numpy())
        r = np.flatnonzero((part.root == np.arange(len(part.i))) & ~top)
        k = np.full(len(p) + len(r), part.rows.column("k")[0].as_py())
        none = np.zeros(len(r), np.int64)
        return pa.Table.from_arrays([
            pa.array(k), pa.array(np.concatenate([part.i[p], out[r]])), pa.array(np.concatenate([np.where(top[p], part.i[p], out[p]), none])),
            pa.array(np.concatenate([np.where(top[p], 0, 1), none])), pa.array(np.concatenate([np.where(top[p], 0, part.depth[p] + 1), none])),
            pa.array(np.concatenate([np.where(top[p], part.depth[p], 0), none])), pa.array(np.concatenate([np.zeros(len(p)), sums[r]])), pa.array(np.arange(len(k)) < len(p)),
        ], names=["k", "i", "anc", "hops", "real", "top", "base", "port"])

    folded = written(own.select("k", "tile", "i", "parent", "weight").join(ports, ["k", "i"], "left").groupBy("k", "tile").applyInArrow(fold, "k bigint, i bigint, anc bigint, hops bigint, real bigint, top bigint, base double, port boolean"), "folded")
    up, n = folded.where("port").select("k", "i", "anc", "hops", "real"), 1
    sums = written(folded.groupBy("k", "i").agg(F.sum("base").alias("sum")), "inflow")
    while True:
        exact = up.where(F.col("hops") == n)
        if exact.limit(1).count() == 0:
            break
        below = exact.join(sums, ["k", "i"]).groupBy("k", F.col("anc").alias("i")).agg(F.sum("sum").alias("below"))
        sums = written(sums.join(below, ["k", "i"], "left").select("k", "i", (F.col("sum") + F.coalesce("below", F.lit(0.0))).alias("sum")), "inflow")
        other = up.select("k", F.col("i").alias("anc"), F.col("anc").alias("next"), F.col("hops").alias("more"), F.col("real").alias("on"))
        up, n = written(up.join(other, ["k", "anc"]).select("k", "i", F.col("next").alias("anc"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("real") + F.col("on")).alias("real")), "out"), 2 * n
    tops = folded.where("port").select("k", F.col("i").alias("anc"), "top")
    told = written(up.join(tops, ["k", "anc"]).select("k", "i", (F.col("real") + F.col("top")).alias("deep")).join(sums, ["k", "i"]), "ports")

    def unfold(rows: pa.Table) -> pa.Table:
        part = _Part(rows)
        col = lambda c: part.rows.column(c).fill_null(0).to_numpy()
        begin = np.where(part.rows.column("deep").is_valid().to_numpy(), col("deep") + 1, 0)
        depth, sums = part.depth + begin[part.root], part.sums(col("weight") + col("sum"))
        return pa.Table.from_arrays([*(part.rows.column(c) for c in ("k", "i", "e", "parent")), pa.array(depth.astype(np.int32)), pa.array(sums)], names=["k", "i", "e", "parent", "depth", "passes"])

    entered = told.select("k", F.col("i").alias("parent"), "deep", F.lit(True).alias("known"))
    both = own.join(told.select("k", "i", "sum"), ["k", "i"], "left").join(entered, ["k", "parent"], "left").withColumn("deep", F.when(F.col("above") != F.col("tile"), F.col("deep")))
    return both.select("k", "tile", "i", "e", "parent", "weight", "sum", "deep").groupBy("k", "tile").applyInArrow(unfold, "k bigint, i bigint, e double, parent bigint, depth int, passes double").hint("merge")
