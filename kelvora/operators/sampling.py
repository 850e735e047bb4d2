"""Population-weighted sampling and joins by place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvora.operators.grid import Grid
from kelvora.operators.order import running_sum

TWO32 = float(2**32)


def sobol_1d(i: Column) -> Column:
    """The bits of i read backwards, as a fraction."""
    return F.conv(F.reverse(F.lpad(F.bin(i), 32, "0")), 2, 10).cast("double") / F.lit(TWO32)


def sobol_2d(i: Column) -> Column:
    """The second coordinate: direction numbers v0 = 2**31, v(j) = v(j-1) ^ (v(j-1) >> 1), combined where i has bit j."""
    numbers, v = [], 1 << 31
    for _ in range(32):
        numbers.append(v)
        v ^= v >> 1
    out = F.lit(0).cast("long")
    for j, v in enumerate(numbers):
        out = out.bitwiseXOR(F.when(F.shiftright(i, j).bitwiseAND(F.lit(1)) == 1, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.cast("double") / F.lit(TWO32)


def scrambled(u: Column, seed: str) -> Column:
    """A sequence's fraction u of 32 bits, scrambled at random within each of its intervals: every bit is turned or not by a
    digest of the seed and all bits above it. Points that share an interval go on sharing one, so the first 2**k points
    stay one to an interval, whatever the seed."""
    x = (u * F.lit(TWO32)).cast("long")

    def bit(j: Column) -> Column:
        above = F.call_function("shiftright", x, j + 1)
        turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), j.cast("string"), above.cast("string"))), 1, 1), 16, 10).cast("long")
        own = F.call_function("shiftright", x, j).bitwiseXOR(turn).bitwiseAND(F.lit(1).cast("long"))
        return F.call_function("shiftleft", own, j)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), bit), F.lit(0).cast("long"), lambda a, b: a + b).cast("double") / F.lit(TWO32)


def population_join(sectors: DataFrame, counts: DataFrame) -> DataFrame:
    """sectors (cd string, ...) with pop by the count's text code; what isn't a number is null."""
    return sectors.join(counts.select(F.col("cd").cast("string").alias("cd"), F.expr("try_cast(pop AS double)").alias("pop")), "cd", "left")


def area(ring: Column) -> Column:
    """Of a ring that isn't closed."""
    n = F.size(ring)
    cross = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, j: a + (F.get(ring, F.pmod(j + 1, n))["y"] * F.get(ring, j)["x"] - F.get(ring, F.pmod(j + 1, n))["x"] * F.get(ring, j)["y"]))
    return F.when(n >= 3, F.abs(cross) / 2).otherwise(F.lit(0.0))


def clip_weights(sectors: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """sectors (cd, pop, ring) whose clipped part has weight: pop * clipped / whole area. Boxes that don't meet go first."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    near = sectors.where((F.array_max(xs) >= x0) & (F.array_min(xs) <= x1) & (F.array_max(ys) >= y0) & (F.array_min(ys) <= y1))
    part = clip("ring", x0, y0, x1, y1)
    return near.withColumn("w", F.col("pop") * area(part) / area(F.col("ring"))).where("w > 0").select("cd", "pop", "ring", "w")


def clip(ring: str, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A ring (array of (x, y), not closed) cut to a rectangle: a fold over its four sides, each of which cuts what is left."""
    sides = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(float(b)).alias("b"), F.lit(less).alias("less")) for axis, b, less in (("x", x0, False), ("x", x1, True), ("y", y0, False), ("y", y1, True))])
    none = F.array().cast("array<struct<x:double,y:double>>")

    def cut(now: Column, side: Column) -> Column:
        own = lambda p: F.when(side["axis"] == "x", p["x"]).otherwise(p["y"])
        inner = lambda p: F.when(side["less"], own(p) <= side["b"]).otherwise(own(p) >= side["b"])

        def each(p: Column, j: Column) -> Column:
            q = F.element_at(now, F.when(j == 0, F.lit(-1)).otherwise(j).cast("int"))
            t = (side["b"] - own(q)) / (own(p) - own(q))
            at = lambda n: F.when(side["axis"] == n, side["b"]).otherwise(q[n] + t * (p[n] - q[n])).alias(n)
            crossing, corner = F.array(F.struct(at("x"), at("y"))), F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))
            return F.when(inner(p) & inner(q), corner).when(inner(p), F.concat(crossing, corner)).when(inner(q), crossing).otherwise(none)

        return F.flatten(F.transform(now, each))

    return F.aggregate(sides, F.col(ring), cut)


def cdf_selection(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """(d, cd): the sector whose share of the running sum of weights holds a draw u, from below and excluding its upper end.
    Draws and bounds meet in hashed slices of the unit interval, so no draw is compared with every sector."""
    total = weights.agg(F.sum("w").alias("total"), F.lit(1).alias("one"))
    run = running_sum(weights.select("cd", "w"), ["cd"], "w", "upto").withColumn("one", F.lit(1)).join(total, "one")
    bounds = run.select("cd", ((F.col("upto") - F.col("w")) / F.col("total")).alias("low"), (F.col("upto") / F.col("total")).alias("high")).where("high > low")
    n = 1024
    sliced = bounds.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") * n).cast("int"), F.least(F.lit(n - 1), F.floor(F.col("high") * n).cast("int")))))
    return draws.withColumn("slice", F.least(F.lit(n - 1), F.floor(F.col("u") * n).cast("int"))).join(sliced, "slice").where("u >= low and u < high").select("d", "cd")


def inside(x: Column, y: Column, ring: Column) -> Column:
    n = F.size(ring)

    def crosses(j: Column) -> Column:
        a, b = F.get(ring, j), F.get(ring, F.pmod(j + n - 1, n))
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.pmod(F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)), F.lit(2)) == 1


def interior_point(ring: Column) -> Column:
    """A point (x, y) inside of a simple ring, however thin: between the two heights of corners that lie around the middle of
    its box a line is drawn, which meets no corner, and the middle of its widest run inside is taken; of equal runs the
    leftmost. Null for a ring without height."""
    ys = F.sort_array(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    middle = (F.element_at(ys, 1) + F.element_at(ys, -1)) / 2
    between = F.transform(F.sequence(F.lit(1), F.size(ys) - 1), lambda j: (F.element_at(ys, j) + F.element_at(ys, j + 1)) / 2)
    line = F.array_min(F.transform(between, lambda m: F.struct(F.abs(m - middle).alias("off"), m.alias("y"))))["y"]
    n = F.size(ring)

    def crossing(y: Column) -> Column:
        def at(j: Column) -> Column:
            a, b = F.get(ring, j), F.get(ring, F.pmod(j + 1, n))
            return F.when((a["y"] > y) != (b["y"] > y), a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))

        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), n - 1), at), lambda x: x.isNotNull()))

    def widest(s: Column) -> Column:
        run = lambda j: F.struct((F.get(s["xs"], 2 * j) - F.get(s["xs"], 2 * j + 1)).alias("less"), F.get(s["xs"], 2 * j).alias("a"), F.get(s["xs"], 2 * j + 1).alias("b"))
        best = F.array_min(F.transform(F.sequence(F.lit(0), (F.size(s["xs"]) / 2).cast("int") - 1), run))
        return F.struct(((best["a"] + best["b"]) / 2).alias("x"), s["y"].alias("y"))

    # One-element arrays name what is used more than once.
    found = F.transform(F.transform(F.array(line), lambda y: F.struct(y.alias("y"), crossing(y).alias("xs"))), widest)
    return F.when(F.size(ys) >= 2, found[0])


def place_inside(picks: DataFrame, tries: int = 64) -> DataFrame:
    """(d, x, y) of picks (d, ring): the first of ``tries`` points of the ring's box, by a low-discrepancy draw from d * tries
    on, that is inside; if none is, as in slivers, its interior point, and the first corner of a ring without height."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = picks.select("d", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))

    def first(found: Column, t: Column) -> Column:
        """What is found, or else the t-th point if that is inside: what comes after a hit isn't drawn."""
        i = F.col("d") * tries + t
        x, y = F.col("x0") + sobol_1d(i) * (F.col("x1") - F.col("x0")), F.col("y0") + sobol_2d(i) * (F.col("y1") - F.col("y0"))
        # A one-element array names the point, so that it is drawn once.
        put = F.filter(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: inside(p["x"], p["y"], F.col("ring")))
        return F.when(F.size(found) > 0, found).otherwise(put)

    none = F.array().cast("array<struct<x:double,y:double>>")
    hit = box.withColumn("p", F.get(F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), none, first), F.lit(0)))
    held = hit.withColumn("q", F.when(F.col("p").isNull(), interior_point(F.col("ring"))))
    return held.select("d", *[F.coalesce(f"p.{a}", f"q.{a}", F.col("ring")[0][a]).alias(a) for a in ("x", "y")])


def points_to_refs(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(k, i, state): the cell of each point (k, r, c); state is kept, outside or masked. Points that share a cell all stay."""
    at = points.select("k", F.floor("r").alias("r"), F.floor("c").alias("c")).withColumn("i", F.when((F.col("r") >= 0) & (F.col("r") < grid.rows) & (F.col("c") >= 0) & (F.col("c") < grid.cols), F.col("r") * grid.cols + F.col("c")))
    held = at.join(cells.select("i", "m"), "i", "left")
    return held.select("k", "i", F.when(F.col("i").isNull(), "outside").when(F.coalesce("m", F.lit(False)), "kept").otherwise("masked").alias("state"))


#: Fixed values of the spread: golden step, edge left free and share used, steps to a passable cell, how many, least spacing.
GOLDEN, EDGE, MIDDLE, STEP_R, STEP_C, STEPS, SPACING = 0.6180339887, 0.2, 0.6, 7, 13, 400, 1 / 8


def spread(cells: DataFrame, grid: Grid, n: int, most: int = 200) -> DataFrame:
    """(k, i): n places over the middle of the grid by golden-ratio steps, moved to a passable cell by steps of a few rows and
    columns, and no two nearer than an eighth of the grid's shorter side. Candidates are a few, whatever the grid's size."""
    begin = lambda size, share: int(size * (EDGE + MIDDLE * (share % 1)))
    spots = [(k, t, (begin(grid.rows, k * GOLDEN) + STEP_R * t) % grid.rows, (begin(grid.cols, k * GOLDEN * GOLDEN) + STEP_C * t) % grid.cols) for k in range(most) for t in range(STEPS)]
    spark = cells.sparkSession
    asked = spark.createDataFrame([(k, t, r * grid.cols + c) for k, t, r, c in spots], "k int, t int, i bigint")
    open_ = asked.join(cells.where("m").select("i"), "i", "left_semi").groupBy("k").agg(F.min(F.struct("t", "i"))["i"].alias("i")).orderBy("k").collect()
    kept: list[tuple[int, int]] = []
    for row in open_:
        if len(kept) < n and all(math.hypot(x // grid.cols - row["i"] // grid.cols, x % grid.cols - row["i"] % grid.cols) >= min(grid.rows, grid.cols) * SPACING for _, x in kept):
            kept.append((len(kept), row["i"]))
    return spark.createDataFrame(kept, "k bigint, i bigint")


def radius_candidates(centres: DataFrame, survey: DataFrame, radius: float, qualify: float, bucket: float) -> DataFrame:
    """(id, picks array<struct<d, x, y, alt>>): survey points (x, y, alt) within radius of each centre (id, x, y), nearest first;
    centres whose nearest is beyond qualify are dropped. bucket is at least half the radius."""
    reach = 2
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    near = centres.withColumn("o", offsets).select("id", "x", "y", (F.floor(F.col("x") / bucket) + F.col("o.a")).alias("bx"), (F.floor(F.col("y") / bucket) + F.col("o.b")).alias("by"))
    held = survey.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "alt", F.floor(F.col("x") / bucket).alias("bx"), F.floor(F.col("y") / bucket).alias("by"))
    d = F.sqrt((F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y")))
    found = near.join(held, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= radius)
    picks = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", F.col("sx").alias("x"), F.col("sy").alias("y"), "alt"))).alias("picks"))
    return picks.where(F.col("picks")[0]["d"] <= qualify)


def review_score(candidates: DataFrame) -> DataFrame:
    """candidates (id, picks, terr, layer) with score, most ambiguous first: gap to the ground, spread of the six nearest, level."""
    alts = F.transform(F.slice("picks", 1, 6), lambda p: p["alt"])
    gap = F.when(F.col("terr").isNotNull(), F.abs(F.col("picks")[0]["alt"] - F.col("terr"))).otherwise(F.lit(0.0))
    spread_ = F.when(F.size(alts) > 1, F.array_max(alts) - F.array_min(alts)).otherwise(F.lit(0.0))
    level = F.when(F.coalesce("layer", F.lit(0)) >= 1, F.lit(5.0)).otherwise(F.lit(0.0))
    return candidates.withColumn("spread", spread_).withColumn("score", -(gap + spread_ + level)).orderBy("score", "id")


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Scored candidates with the last decision (id, status, ele, source, dist, note, ts) on each; without one, or without a
    status, a candidate is pending. Of decisions at the same time the greatest counts."""
    last = decisions.groupBy("id").agg(F.max(F.struct("ts", "status", "ele", "source", "dist", "note")).alias("decision"))
    return candidates.join(last, "id", "left").withColumn("status", F.coalesce("decision.status", F.lit("pending")))


def shown(rows: DataFrame, which: str = "all") -> DataFrame:
    """Reviewed candidates under a filter: all, flagged (the six nearest are more than 5 apart) or a status."""
    if which == "all":
        return rows
    return rows.where(F.col("spread") > 5) if which == "flagged" else rows.where(F.col("status") == which)


def validated(rows: DataFrame, survey: str = "survey") -> DataFrame:
    """What is exported of the approved: elevations to a decimal, where they come from, and how far above the ground they are.
    A manual elevation has no distance."""
    manual = F.col("decision.source") == "manual"
    dist = F.when(F.coalesce(manual, F.lit(False)), None).otherwise(F.col("decision.dist"))
    ele = F.col("decision.ele")
    return shown(rows, "approved").select(
        F.col("id").alias("osm_id"), "name", "highway", "layer", F.round(ele, 1).alias("ele"), F.when(manual, "manual").otherwise(survey).alias("ele_source"), dist.alias("source_dist_m"),
        F.col("terr").alias("terrain"), F.round(ele - F.col("terr"), 1).alias("terrain_gap"), F.col("y").alias("center_lat"), F.col("x").alias("center_lng"), F.coalesce("decision.note", F.lit("")).alias("note"),
    )


def arc_centre(vertices: DataFrame) -> DataFrame:
    """(line, x, y, length): the point at half of each line's length."""
    by = Window.partitionBy("line").orderBy("seq")
    step = vertices.select("line", "seq", "x", "y", F.lead("x").over(by).alias("x2"), F.lead("y").over(by).alias("y2")).where("x2 is not null")
    d = F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")))
    run = step.withColumn("d", d).withColumn("upto", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("d").over(Window.partitionBy("line")))
    hit = run.where(F.col("upto") >= F.col("total") / 2).groupBy("line").agg(F.min(F.struct("seq", "x", "y", "x2", "y2", "d", "upto", "total")).alias("p")).select("line", "p.*")
    t = F.when(F.col("d") > 0, 1 - (F.col("upto") - F.col("total") / 2) / F.col("d")).otherwise(F.lit(0.0))
    return hit.select("line", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"), F.col("total").alias("length"))
