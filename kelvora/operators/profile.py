"""Ride profiles: segments (track, seq, d, dh) in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvora.functions.cost import Cost
from kelvora.operators.order import at_places, quantiles

CELL_M = 30.0


def lists(seg: DataFrame) -> DataFrame:
    """(track, x, h): cumulative distances and heights from 0, an array per track."""
    by = Window.partitionBy("track").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = seg.select("track", "seq", F.sum("d").over(by).alias("x"), F.sum("dh").over(by).alias("h"))
    points = run.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "h"))).alias("p"))
    zero = F.array(F.lit(0.0))
    return points.select("track", F.concat(zero, F.transform("p", lambda p: p["x"])).alias("x"), F.concat(zero, F.transform("p", lambda p: p["h"])).alias("h"))


def deadband(tracks: DataFrame, tau: float = 2.0) -> DataFrame:
    """tracks (track, x, h) with hs: heights that follow h only when it leaves a band of tau around them. Each height hangs on
    the one before, so a track is walked once, in Arrow batches of tracks."""

    @F.pandas_udf("array<double>")
    def follow(h: pd.Series) -> pd.Series:
        def one(own):
            out = list(own[:1])
            for x in own[1:]:
                last = out[-1]
                out.append(x - tau if x > last + tau else x + tau if x < last - tau else last)
            return out

        return h.map(one)

    return tracks.withColumn("hs", follow("h"))


def recovery(tracks: DataFrame, cost: Cost) -> DataFrame:
    """(track, eps): drops of 30 m cells of the raw profile, each weighted by what its grade lets one recover."""
    sized = tracks.withColumn("nc", F.floor((F.element_at("x", -1) - F.col("x")[0]) / CELL_M).cast("int"))
    seg = sized.where("nc >= 2").select("track", "nc", F.explode(F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda j: F.struct(j.alias("j"), F.col("x")[j - 1].alias("x0"), F.col("x")[j].alias("x1"), F.col("h")[j - 1].alias("h0"), F.col("h")[j].alias("h1")))).alias("s")).select("track", "nc", "s.*")
    # A place belongs to the first segment whose end isn't before it: each segment lists the marks it holds, the first also 0.
    none = F.array().cast("array<int>")
    begun, ended = F.floor(F.col("x0") / CELL_M).cast("int"), F.floor(F.col("x1") / CELL_M).cast("int")
    own = F.concat(F.when(F.col("j") == 1, F.array(F.lit(0))).otherwise(none), F.when(ended > begun, F.sequence(begun + 1, ended)).otherwise(none))
    held = seg.withColumn("k", F.explode(own)).where("k <= nc")
    f = F.when(F.col("k") == 0, F.lit(0.0)).otherwise((F.col("k") * CELL_M - F.col("x0")) / (F.col("x1") - F.col("x0")))
    marks = held.select("track", "k", (F.col("h0") * (1 - f) + F.col("h1") * f).alias("hk"))
    drop = -(F.col("hk") - F.lag("hk").over(Window.partitionBy("track").orderBy("k")))
    part = marks.withColumn("drop", drop).where("drop > 0").groupBy("track").agg(F.sum("drop").alias("hd"), F.sum(F.col("drop") * F.least(F.lit(1.0), F.lit(cost.ab_ratio) / (F.col("drop") / CELL_M))).alias("ew"))
    eps = F.when(F.coalesce("hd", F.lit(0.0)) < 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ew") / F.col("hd") - cost.eps_offset)))
    return tracks.select("track").join(part, "track", "left").select("track", eps.alias("eps"))


def track_energy(seg: DataFrame, cost: Cost, tau: float = 2.0) -> DataFrame:
    """(track, energy) in kJ, with heights past the deadband and recovery from the raw profile."""
    tracks = lists(seg)
    steps = deadband(tracks, tau).select("track", F.explode(F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda j: F.struct((F.col("x")[j] - F.col("x")[j - 1]).alias("d"), (F.col("hs")[j] - F.col("hs")[j - 1]).alias("dh")))).alias("s")).select("track", "s.*").where("d > 0")
    up = F.col("dh") >= 0
    sums = steps.groupBy("track").agg(F.sum("d").alias("x"), F.sum(F.when(~up | (F.col("dh") < F.lit(cost.climb_thr) * F.col("d")), F.col("d")).otherwise(0.0)).alias("xnc"), F.sum(F.when(up, F.col("dh")).otherwise(0.0)).alias("plus"), F.sum(F.when(up, 0.0).otherwise(-F.col("dh"))).alias("minus"))
    return sums.join(recovery(tracks, cost), "track").select("track", (F.lit(cost.a_roll) * F.col("x") + F.lit(cost.a_aero) * F.col("xnc") + F.lit(cost.beta) * (F.col("plus") - F.col("eps") * F.col("minus"))).alias("energy"))


def ascent(seg: DataFrame) -> DataFrame:
    """(track, dist, up, down)."""
    return seg.groupBy("track").agg(F.sum("d").alias("dist"), F.sum(F.greatest(F.lit(0.0), F.col("dh"))).alias("up"), F.sum(F.greatest(F.lit(0.0), -F.col("dh"))).alias("down"))


def ratio_stats(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, p50, p90, max): a quantile is the sorted value at floor(p n), held below n. No group is gathered."""
    found = quantiles(values, by, value, {"p50": 0.5, "p90": 0.9})
    sums = values.groupBy(by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return found.join(sums, by).select(by, F.col("n").cast("int").alias("n"), "mean", "p50", "p90", "max")


def median_ratios(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, ratio): the median of y / x of each group, as ratio_stats takes it."""
    ratios = pairs.where("x != 0").select(by, (F.col("y") / F.col("x")).alias("ratio_"))
    return quantiles(ratios, by, "ratio_", {"ratio": 0.5})


def heading_buckets(field: DataFrame, cols: int, seed: int, dx: float, dy: float, degrees: int = 5) -> DataFrame:
    """(bucket, n, mean_e) of a field's cells by heading from the seed, clockwise from north."""
    r, c = F.floor(F.col("i") / cols) - seed // cols, F.pmod("i", F.lit(cols)) - seed % cols
    angle = F.pmod(F.degrees(F.atan2(c * dx, -r * dy)), F.lit(360.0))
    return field.where(F.col("i") != seed).groupBy(F.floor(angle / degrees).alias("bucket")).agg(F.count("*").alias("n"), F.avg("e").alias("mean_e"))


def reach_area(field: DataFrame, budgets: list[float], dx: float, dy: float) -> DataFrame:
    """(k, budget, area): the area of the cells within each of a few budgets."""
    return field.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("e <= budget").groupBy("k", "budget").agg((F.count("*") * dx * dy).alias("area"))


def correction_fit(pairs: DataFrame, by: str) -> DataFrame:
    """(by, slope, intercept, r2) of y on x."""
    return pairs.groupBy(by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


#: A source's cells meet what is known of it in so many parts.
SALTS = 32


def reach_match(own: DataFrame, reference: DataFrame, by: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, share, budget, target, inflation): by how much a budget has to grow for energies own (by, e) to reach as many
    cells as reference (by, e) reaches within it. Budgets are own's quantiles; target counts the reference's cells within;
    inflation is null where that is none or the budget is 0. A source may hold most of all rows."""
    names = {f"s{j}": p for j, p in enumerate(shares)}
    budgets = quantiles(own, by, "e", names)
    wide = budgets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = reference.select(by, F.col("e").alias("e")).where("e is not null").withColumn("salt", F.pmod(F.xxhash64("e"), F.lit(SALTS)).cast("int"))
    within = dealt.join(wide, [by, "salt"]).groupBy(by).agg(*[F.count(F.when(F.col("e") <= F.col(k), 1)).alias(f"t_{k}") for k in names])
    told = budgets.join(within, by, "left").select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("share"), F.col(k).alias("budget"), F.coalesce(f"t_{k}", F.lit(0)).alias("target")) for k, p in names.items()])).alias("x")).select(by, "x.*")
    found = at_places(own, by, "e", told.select(by, "name", (F.col("target") - 1).alias("at")))
    return told.join(found, [by, "name"], "left").select(by, "share", "budget", "target", F.when(F.col("budget") != 0, F.col("value") / F.col("budget")).alias("inflation"))


def correction_errors(pairs: DataFrame, by: str) -> DataFrame:
    """(kind, n, p50, p90, p99, worst, under) of how far ratios y / x of pairs (by, x, y, d) are from what is told of them: raw
    tells 1; shared tells the mean of the sources' medians; fitted tells a line in x / d, by least squares over all pairs.
    under is the share of ratios that are below it. Pairs without a ratio or a distance take no part."""
    ratios = pairs.where("x != 0 and d != 0 and y is not null").select(F.col(by), (F.col("y") / F.col("x")).alias("ratio"), (F.col("x") / F.col("d")).alias("hill"))
    shared = quantiles(ratios, by, "ratio", {"p50": 0.5}).agg(F.avg("p50")).first()[0]
    slope, intercept = ratios.agg(F.regr_slope("ratio", "hill"), F.regr_intercept("ratio", "hill")).first()
    line = F.lit(intercept).cast("double") + F.lit(slope).cast("double") * F.col("hill")
    told = {"raw": F.lit(1.0), "shared": F.lit(shared).cast("double"), "fitted": line}
    each = ratios.select("ratio", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("told")) for k, v in told.items()])).alias("x")).select(F.col("x.kind").alias("kind"), "ratio", F.col("x.told").alias("told"))
    errors = each.select("kind", F.abs(F.col("ratio") / F.col("told") - 1).alias("error"), (F.col("ratio") < F.col("told")).cast("double").alias("below")).where("error is not null")
    spread = quantiles(errors, "kind", "error", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return spread.join(errors.groupBy("kind").agg(F.max("error").alias("worst"), F.avg("below").alias("under")), "kind")
