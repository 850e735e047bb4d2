"""Raster operators over cells (i, r, c, value ...)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvora.operators.grid import Grid


def _offsets(pairs: Sequence[tuple]) -> Column:
    names = ("dr", "dc", "w")
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p, strict=False)]) for p in pairs]))


def chamfer(cells: DataFrame, seeds: DataFrame, grid: Grid) -> DataFrame:
    """(i, d): 3-4 distance in cells to the nearest seed (i), over all cells of the grid.

    On a full grid a shortest way from a seed is diagonal steps and then straight ones, so the transform is running minima
    along both diagonals and then along rows and columns, each in both directions. It takes no iteration and no search."""
    seed = seeds.select("i", F.lit(0).alias("d")).distinct()
    out = cells.select("i", "r", "c").join(seed, "i", "left")
    for step, lines in ((4, (("r - c", "r"), ("r + c", "r"))), (3, (("r", "c"), ("c", "r")))):
        near = [F.col("d")]
        for line, along in lines:
            for way in (1, -1):
                before = Window.partitionBy(F.expr(line)).orderBy((F.col(along) * way).asc()).rowsBetween(Window.unboundedPreceding, 0)
                near.append(F.min(F.col("d") - step * way * F.col(along)).over(before) + step * way * F.col(along))
        out = out.select("i", "r", "c", F.least(*near).alias("d"))
    return out.where("d is not null").select("i", (F.col("d") / 3.0).alias("d"))


def idw_fill(cells: DataFrame, grid: Grid, max_distance: int) -> DataFrame:
    """(i, e): cells with net and e keep e; every other gets the inverse-square mean of the first such cell along each of
    eight rays, at most max_distance cells away; none: no row. A ray is a window along a row, column or diagonal."""
    diag = math.hypot(grid.dx, grid.dy)
    seed = F.when(F.col("net") & F.col("e").isNotNull(), F.struct("e", F.col("r").alias("sr"), F.col("c").alias("sc")))
    lines = (("r", "c", grid.dx), ("c", "r", grid.dy), ("r - c", "r", diag), ("r + c", "r", diag))
    own = cells.withColumn("seed", seed)
    for k, (line, order, step) in enumerate(lines):
        by = Window.partitionBy(F.expr(line)).orderBy(order)
        away = lambda x: F.greatest(F.abs(x["sr"] - F.col("r")), F.abs(x["sc"] - F.col("c")))
        for side, frame, pick in (("a", by.rangeBetween(-max_distance, -1), F.last), ("b", by.rangeBetween(1, max_distance), F.first)):
            first = f"{side}{k}"
            own = own.withColumn(first, pick("seed", ignorenulls=True).over(frame))
            own = own.withColumn(first, F.when(F.col(first).isNotNull(), F.struct(F.col(first)["e"].alias("e"), (away(F.col(first)) * F.lit(step)).alias("d"))))
    hits = F.filter(F.array(*[F.col(f"{s}{k}") for k in range(4) for s in "ab"]), lambda x: x.isNotNull())
    weight = F.aggregate("hits", F.lit(0.0), lambda a, x: a + 1 / (x["d"] * x["d"]))
    mean = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["e"] / (x["d"] * x["d"])) / weight
    told = own.withColumn("hits", hits).withColumn("e", F.when(F.col("seed").isNotNull(), F.col("e")).when(F.col("m") & (F.size("hits") > 0), mean))
    return told.where("e is not null and m").select("i", "e")


def box_smooth(cells: DataFrame, grid: Grid) -> DataFrame:
    """(i, e): cells (i, r, c, m, net, e) off the network take the mean of the known cells of their 3 x 3 block."""
    known = cells.where("m and e is not null")
    spread = known.select("r", "c", "e", _offsets([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "e")
    mean = spread.groupBy("r", "c").agg(F.avg("e").alias("mean"))
    return known.join(mean, ["r", "c"], "left").select("i", F.when(F.col("net"), F.col("e")).otherwise(F.col("mean")).alias("e"))


def fill_across(cells: DataFrame, grid: Grid, max_distance: int, smoothing: int = 0) -> DataFrame:
    out = idw_fill(cells, grid, max_distance)
    for _ in range(smoothing):
        out = box_smooth(cells.drop("e").join(out, "i", "left"), grid)
    return out


def gaussian_weights(sigma_px: float) -> list[float]:
    return [math.exp(-(k * k) / (2 * sigma_px * sigma_px)) for k in range(math.ceil(3 * sigma_px) + 1)]


def gaussian_smooth(cells: DataFrame, grid: Grid, sigma_m: float) -> DataFrame:
    """(i, r, c, h): mask-normalised, along rows and then along columns, held as float between."""
    out = cells.where("m").select("i", "r", "c", "h")
    for line, along, size in (("r", "c", grid.dx), ("c", "r", grid.dy)):
        w = gaussian_weights(sigma_m / size)
        reach = len(w) - 1
        if reach < 1:
            continue
        own = Window.partitionBy(line).orderBy(along).rangeBetween(-reach, reach)
        table = F.array(*[F.lit(x) for x in w])
        near = out.withColumn("near", F.sort_array(F.collect_list(F.struct(F.col(along).alias("a"), F.col("h").cast("double").alias("h"))).over(own)))
        out = near.withColumn("h", (_folded(along, table, True) / _folded(along, table, False)).cast("float")).drop("near")
    return out


def _folded(along: str, table: Column, with_height: bool) -> Column:
    def add(acc: Column, x: Column) -> Column:
        w = F.get(table, F.abs(x["a"] - F.col(along)).cast("int"))
        return acc + (w * x["h"] if with_height else w)

    return F.aggregate("near", F.lit(0.0), add)


def block_average(cells: DataFrame, n: int) -> DataFrame:
    """(r, c, h, n): the mean of the unmasked cells of each n x n block."""
    return cells.where("m").groupBy(F.floor(F.col("r") / n).alias("r"), F.floor(F.col("c") / n).alias("c")).agg(F.avg(F.col("h").cast("double")).alias("h"), F.count("*").alias("n"))


def crop(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    return cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def decimate(cells: DataFrame, grid: Grid, k: int) -> DataFrame:
    """Smoothed by half a block's width, then every k-th cell."""
    return gaussian_smooth(cells, grid, k * grid.dx / 2).where((F.col("r") % k == 0) & (F.col("c") % k == 0))


def mask_coverage(cells: DataFrame, n: int, least: float = 0.5) -> DataFrame:
    """(r, c, passable): a coarse cell is closed if at least that share of its fine cells is."""
    return cells.groupBy(F.floor(F.col("r") / n).alias("r"), F.floor(F.col("c") / n).alias("c")).agg((F.avg(F.when(F.col("m"), 0.0).otherwise(1.0)) < least).alias("passable"))


def mask_footprint(cells: DataFrame, fine: Grid, rows: int, cols: int, r0: float, c0: float, scale: float, samples: int = 4, least: float = 0.5) -> DataFrame:
    """(r, c, passable) of a coarse grid of rows x cols cells, each ``scale`` fine cells wide, whose corner lies at (r0, c0) of
    the fine grid. A cell is closed if at least that share of samples x samples points of its footprint lies on closed
    cells; points outside the fine grid are open."""
    spark = cells.sparkSession
    at = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    coarse = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), F.pmod("id", F.lit(cols)).alias("c"))
    points = coarse.select("r", "c", at.alias("a")).select("*", at.alias("b"))
    fr = F.floor(r0 + (F.col("r") + (F.col("a") + 0.5) / samples) * scale)
    fc = F.floor(c0 + (F.col("c") + (F.col("b") + 0.5) / samples) * scale)
    inside = (fr >= 0) & (fr < fine.rows) & (fc >= 0) & (fc < fine.cols)
    held = points.select("r", "c", F.when(inside, fr * fine.cols + fc).alias("i")).join(cells.select("i", "m"), "i", "left")
    return held.groupBy("r", "c").agg((F.avg(F.when(F.col("m"), 0.0).when(F.col("i").isNotNull() & ~F.coalesce("m", F.lit(False)), 1.0).otherwise(0.0)) < least).alias("passable"))


#: Heights are smoothed by so many metres where cells are no larger; an export that says so isn't smoothed again.
AUTO_SIGMA_M = 10.0


def auto_sigma(dx: float, dy: float, tags: dict[str, str] | None = None) -> float:
    """Metres to smooth heights by, 0 for none."""
    return 0.0 if "smoothed" in (tags or {}) or max(dx, dy) > AUTO_SIGMA_M else AUTO_SIGMA_M


def local_grade(pairs: DataFrame, threshold: float) -> DataFrame:
    """(i, grade, steep) from grid.neighbours."""
    return pairs.groupBy(F.col("u").alias("i")).agg(F.max(F.abs(F.col("hv") - F.col("hu")) / F.col("dist")).alias("grade")).withColumn("steep", F.col("grade") >= threshold)


def dilate(cells: DataFrame, flagged: DataFrame, reach: int = 1) -> DataFrame:
    """(i) of cells within reach rows and columns of a flagged one."""
    offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    near = cells.join(flagged.select("i").distinct(), "i", "left_semi").select("r", "c", _offsets(offsets).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()
    return cells.join(near, ["r", "c"], "left_semi").select("i")


def sample(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """points (p, r, c in fractional cells) with height: bilinear over the unmasked of four cells, whose values stand at
    their centres; with none, the upper left cell's own."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(grid.rows - 1.0), F.col("r") - 0.5))
    c = F.greatest(F.lit(0.0), F.least(F.lit(grid.cols - 1.0), F.col("c") - 0.5))
    at = points.select("p", r.alias("r"), c.alias("c")).withColumn("r0", F.floor("r")).withColumn("c0", F.floor("c"))
    fr, fc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    r1, c1 = F.least(F.col("r0") + 1, F.lit(grid.rows - 1)), F.least(F.col("c0") + 1, F.lit(grid.cols - 1))
    corner = lambda q, a, b, w: F.struct(F.lit(q).alias("q"), (a * grid.cols + b).alias("i"), w.alias("w"))
    four = at.select("p", F.explode(F.array(corner(0, F.col("r0"), F.col("c0"), (1 - fr) * (1 - fc)), corner(1, F.col("r0"), c1, (1 - fr) * fc), corner(2, r1, F.col("c0"), fr * (1 - fc)), corner(3, r1, c1, fr * fc))).alias("x")).select("p", "x.*")
    held = four.join(cells.select("i", F.col("h").cast("double").alias("h"), "m"), "i")
    parts = held.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("q", "w", "h", "m"))).alias("x"))
    inside = F.filter("x", lambda y: y["m"])
    total = F.aggregate(inside, F.lit(0.0), lambda a, y: a + y["w"])
    value = F.aggregate(inside, F.lit(0.0), lambda a, y: a + y["h"] * y["w"])
    return parts.select("p", F.when(total > 0, value / total).otherwise(F.filter("x", lambda y: y["q"] == 0)[0]["h"]).alias("height"))


def _crossings(edges: DataFrame, line: Column, a: str, b: str, first: str, second: str, n: int) -> DataFrame:
    """edges (poly, x0, y0, x1, y1) that pass the centre of a line of cells, and where: (poly, line, p, sign)."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    span = edges.where(F.col(a) != F.col(b)).withColumn("line", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(low - 0.5).cast("int")), F.greatest(F.least(F.lit(n - 1), F.ceil(high).cast("int")), F.greatest(F.lit(0), F.floor(low - 0.5).cast("int"))))))
    centre = F.col("line") + 0.5
    hit = span.where((F.col(a) > centre) != (F.col(b) > centre)).where(F.col("line") < n)
    return hit.select("poly", "line", (F.col(first) + (centre - F.col(a)) / (F.col(b) - F.col(a)) * (F.col(second) - F.col(first))).alias("p"), (F.col(b) < F.col(a)).alias("falls"))


def polygon_fill(rings: DataFrame, grid: Grid) -> DataFrame:
    """(poly, r, c) from ring edges (poly, x0, y0, x1, y1): between odd and even crossings of each row's centre line, so
    inner rings are holes."""
    at = _crossings(rings, F.col("line"), "y0", "y1", "x0", "x1", grid.rows).withColumn("n", F.row_number().over(Window.partitionBy("poly", "line").orderBy("p")))
    pairs = at.groupBy("poly", "line", F.floor((F.col("n") - 1) / 2).alias("pair")).agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("k")).where("k = 2")
    first, last = F.greatest(F.lit(0), F.ceil(F.col("a") - 0.5).cast("int")), F.least(F.lit(grid.cols - 1), F.floor(F.col("b") - 0.5).cast("int"))
    return pairs.where(first <= last).select("poly", F.col("line").alias("r"), F.explode(F.sequence(first, last)).alias("c")).distinct()


def sea_flood(coast: DataFrame, grid: Grid) -> DataFrame:
    """(r, c) of sea cells from directed coastline edges (poly, x0, y0, x1, y1), land to their left: in each row and each
    column the crossing before a cell decides its side, or before the first one, that one."""
    out = None
    for a, b, first, second, lines, cells, flip in (("y0", "y1", "x0", "x1", grid.rows, grid.cols, False), ("x0", "x1", "y0", "y1", grid.cols, grid.rows, True)):
        at = _crossings(coast, F.col("line"), a, b, first, second, lines).select("line", "p", (~F.col("falls") if flip else F.col("falls")).alias("sea"))
        by = Window.partitionBy("line").orderBy("p")
        begin = F.when(F.row_number().over(by) == 1, F.lit(0)).otherwise(F.ceil(F.col("p") - 0.5).cast("int"))
        own = at.withColumn("next", F.lead("p").over(by)).withColumn("n", F.row_number().over(by)).withColumn("begin", begin)
        runs = own.select("line", "p", "sea", "n", F.greatest(F.lit(0), F.col("begin")).alias("begin"), F.least(F.lit(cells - 1), F.coalesce(F.ceil(F.col("next") - 0.5).cast("int") - 1, F.lit(cells - 1))).alias("end"))
        # Before the first crossing its own side holds too: a run from 0 has it on both sides of the line.
        wet = runs.where("sea and begin <= end").select("line", F.explode(F.sequence("begin", "end")).alias("at"))
        here = wet.select(F.col("line").alias("r"), F.col("at").alias("c")) if not flip else wet.select(F.col("at").alias("r"), F.col("line").alias("c"))
        out = here if out is None else out.union(here)
    return out.distinct()


def supercover(lines: DataFrame, grid: Grid) -> DataFrame:
    """(poly, r, c): the 4-connected cells that polyline edges (poly, x0, y0, x1, y1) pass. The row and column steps of an
    edge are met in the order of their distance along it; at a tie the row comes first."""

    def steps(a: str, b: str, flag: int) -> Column:
        d, i, j = F.col(b) - F.col(a), F.floor(F.col(a)), F.floor(F.col(b))
        n = F.abs(j - i)
        at = lambda k: F.struct(((i + F.when(d > 0, k).otherwise(1 - k) - F.col(a)) / d).alias("t"), F.lit(flag).alias("axis"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), at)).otherwise(F.array().cast("array<struct<t:double,axis:int>>"))

    own = lines.withColumn("steps", F.sort_array(F.concat(steps("y0", "y1", 0), steps("x0", "x1", 1))))
    count = lambda flag, upto: F.size(F.filter(F.slice("steps", 1, upto), lambda s: s["axis"] == flag))
    sign = lambda a, b: F.when(F.col(b) > F.col(a), 1).otherwise(-1)
    each = own.select("poly", "x0", "y0", "x1", "y1", "steps", F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("k"))
    out = each.select("poly", (F.floor("y0") + sign("y0", "y1") * count(0, F.col("k"))).cast("int").alias("r"), (F.floor("x0") + sign("x0", "x1") * count(1, F.col("k"))).cast("int").alias("c"))
    return out.where(F.col("r").between(0, grid.rows - 1) & F.col("c").between(0, grid.cols - 1)).distinct()


def carve(terrain: DataFrame, corridor: DataFrame, low: float = -5.0, high: float = 15.0) -> DataFrame:
    """Cells of corridor (i, t in 0..1, offset) opened and raised by a ramp that is 0 at its ends and offset at its middle."""
    ramp = F.greatest(F.lit(low), F.least(F.lit(high), F.col("offset"))) * (1 - F.abs(2 * F.col("t") - 1))
    return terrain.join(corridor.withColumn("rise", ramp).groupBy("i").agg(F.max("rise").alias("rise")), "i", "left").select("i", "r", "c", (F.col("h") + F.coalesce("rise", F.lit(0.0))).alias("h"), (F.col("m") | F.col("rise").isNotNull()).alias("m"))


def hillshade(pairs: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(i, shade) in 0..1 from the four-neighbour slopes of grid.neighbours over 4 moves (north, west, east, south)."""
    z, a = math.radians(90 - altitude), math.radians(360 - azimuth + 90)
    rise = lambda k: F.max(F.when(F.col("k") == k, (F.col("hv") - F.col("hu")) / F.col("dist")))
    per = pairs.groupBy(F.col("u").alias("i")).agg(*[rise(k).alias(f"s{k}") for k in range(4)])
    gx, gy = (F.coalesce("s2", F.lit(0.0)) - F.coalesce("s1", F.lit(0.0))) / 2, (F.coalesce("s3", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0))) / 2
    slope, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    return per.select("i", F.greatest(F.lit(0.0), math.cos(z) * F.cos(slope) + math.sin(z) * F.sin(slope) * F.cos(F.lit(a) - aspect)).alias("shade"))


def percentiles(cells: DataFrame, shares: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """(n, p10, p90 ...) of the open cells' heights: the sorted height at floor(share * n), exactly, by ``order.quantiles``."""
    from kelvora.operators import order

    held = cells.where("m").select(F.lit(0).alias("all"), F.col("h").cast("double").alias("h"))
    return order.quantiles(held, "all", "h", {f"p{round(100 * s)}": s for s in shares}).drop("all")


def mean_filter(cells: DataFrame, reach: int) -> DataFrame:
    """(i, h): the mean height of the open cells at most reach rows and columns away, for every open cell. Sums of a row's
    reach come first, and then sums of those, so that work doesn't grow with reach."""
    near = lambda line, along: Window.partitionBy(line).orderBy(along).rangeBetween(-reach, reach)
    known = F.when(F.col("m"), F.col("h").cast("double"))
    row = cells.select("i", "r", "c", "m", F.sum(known).over(near("r", "c")).alias("s"), F.count(known).over(near("r", "c")).alias("n"))
    block = row.select("i", "m", (F.sum("s").over(near("c", "r")) / F.sum("n").over(near("c", "r"))).alias("h"))
    return block.where("m").select("i", "h")


def assemble_rings(ways: DataFrame, tol: float = 1e-7) -> DataFrame:
    """(rel, ring, seq, x, y) from a relation's ways (rel, way, seq, x, y): ways that share an end are joined, either way round,
    until they close; what stays open is dropped. A task holds one relation's ways."""
    import pandas as pd

    def stitch(key, group: pd.DataFrame) -> pd.DataFrame:
        near = lambda p, q: abs(p[0] - q[0]) <= tol and abs(p[1] - q[1]) <= tol
        slot = lambda p: (int(p[0] // (2 * tol)), int(p[1] // (2 * tol)))
        left = {w: list(zip(own["x"], own["y"], strict=True)) for w, own in group.sort_values("seq").groupby("way")}
        at: dict = {}
        for w, own in left.items():
            for p in (own[0], own[-1]):
                at.setdefault(slot(p), []).append(w)

        def follow(p):
            """The smallest way left that has an end within tol, on whichever side of a slot's edge it lies."""
            a, b = slot(p)
            around = {w for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for w in at.get((i, j), ()) if w in left}
            return min((w for w in around if near(left[w][0], p) or near(left[w][-1], p)), default=None)

        rows, ring = [], 0
        for w in sorted(left):
            if w not in left:
                continue
            chain = left.pop(w)
            while not near(chain[0], chain[-1]) or len(chain) < 3:
                nxt = follow(chain[-1])
                if nxt is None:
                    break
                own = left.pop(nxt)
                chain += own[1:] if near(own[0], chain[-1]) else own[-2::-1]
            if len(chain) >= 3 and near(chain[0], chain[-1]):
                rows += [(key[0], ring, j, x, y) for j, (x, y) in enumerate(chain)]
                ring += 1
        return pd.DataFrame(rows, columns=["rel", "ring", "seq", "x", "y"])

    return ways.groupBy("rel").applyInPandas(stitch, "rel bigint, ring int, seq int, x double, y double")
