"""Street networks: polylines to a planar graph with directed costs, and searches on it.

Coordinates are fractional cells (r, c); a cell's value stands at its centre. Candidate pairs come from an equi-join on
the cells that segments pass through, so no pair of far segments is ever formed. A pair that meets in several cells is
told in the cell of the point where it meets, so that nothing has to be made distinct, and a cell that is hot is split by
the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvora.functions.cost import Cost, edge_cost
from kelvora.operators import raster
from kelvora.operators.components import components
from kelvora.operators.grid import Grid
from kelvora.operators.search import written


@dataclass(frozen=True)
class Rules:
    snap_tol: float = 0.5
    step_cells: float = 1.0
    z_tol: float = 1.0
    eps: float = 1e-9
    crossings: bool = True


NODE_SPAN = 1 << 31


def node_key(r: Column, c: Column, tol: float) -> Column:
    """One number for each snapped place: halves round up."""
    at = lambda x: F.floor(x / F.lit(tol) + 0.5)
    return at(r) * F.lit(NODE_SPAN) + at(c)


def tiling(grid: Grid, tol: float = Rules.snap_tol, size: int = 64):
    """Squares of so many cells of the grid, from a node's key (``node_key``); what lies beyond the grid's sides is in the next."""
    across, keys = grid.cols // size + 1, F.lit(round(size / tol))
    return lambda n: F.floor(F.shiftright(n, 31) / keys) * across + F.greatest(F.lit(0), F.least(F.lit(across - 1), F.floor(n.bitwiseAND(F.lit(NODE_SPAN - 1)) / keys)))


def segments(vertices: DataFrame) -> DataFrame:
    """(s, line, seq, r1, c1, z1, r2, c2, z2, arc) from vertices (line, seq, r, c[, z]); zero-length ones are dropped. s is
    line * 2**20 + seq, so segments sort as their lines do."""
    by = Window.partitionBy("line").orderBy("seq")
    z = F.col("z").cast("double") if "z" in vertices.columns else F.lit(None).cast("double")
    own = vertices.select("line", "seq", F.col("r").alias("r1"), F.col("c").alias("c1"), z.alias("z1"))
    out = own.select("*", F.lead("r1").over(by).alias("r2"), F.lead("c1").over(by).alias("c2"), F.lead("z1").over(by).alias("z2")).where("r2 is not null and not (r1 = r2 and c1 = c2)")
    d = F.sqrt((F.col("r2") - F.col("r1")) * (F.col("r2") - F.col("r1")) + (F.col("c2") - F.col("c1")) * (F.col("c2") - F.col("c1")))
    return out.select((F.col("line") * (1 << 20) + F.col("seq")).alias("s"), "*", (F.sum(d).over(by.rowsBetween(Window.unboundedPreceding, 0)) - d).alias("arc"))


#: What is added to a segment's reach, in cells, against rounding.
COVER_EPS = 1e-6


def _covered() -> Column:
    """The cells (r, c) that a segment passes through, row by row."""
    e, r1, c1, r2, c2 = F.lit(COVER_EPS), *map(F.col, ("r1", "c1", "r2", "c2"))
    low, high = F.least(r1, r2), F.greatest(r1, r2)
    at = lambda r: F.when(r1 == r2, c1).otherwise(c1 + (c2 - c1) * ((r - r1) / (r2 - r1)))

    def row(k: Column) -> Column:
        a, b = at(F.greatest(k - e, low)), at(F.least(k + 1 + e, high))
        left = F.floor(F.when(r1 == r2, F.least(c1, c2)).otherwise(F.least(a, b)) - e)
        right = F.floor(F.when(r1 == r2, F.greatest(c1, c2)).otherwise(F.greatest(a, b)) + e)
        return F.transform(F.sequence(left, right), lambda c: F.struct(k.cast("long").alias("r"), c.cast("long").alias("c")))

    return F.flatten(F.transform(F.sequence(F.floor(low - e), F.floor(high + e)), row))


_GEOMETRY = ("s", "line", "r1", "c1", "z1", "r2", "c2", "z2")


def _in_cells(seg: DataFrame) -> DataFrame:
    """(br, bc, _GEOMETRY), a row per cell that a segment passes through."""
    return seg.select(*_GEOMETRY, F.explode(_covered()).alias("at")).select(F.col("at.r").alias("br"), F.col("at.c").alias("bc"), *_GEOMETRY)


def _around() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def crossings(seg: DataFrame, rules: Rules = Rules(), meta: DataFrame | None = None) -> DataFrame:
    """(a, b, t, u): proper intersections of segments of different lines. meta (line, deck, layer) keeps levels apart."""
    cells = _in_cells(seg)
    side = lambda n: cells.select("br", "bc", *[F.col(x).alias(f"{x}_{n}") for x in _GEOMETRY])
    both = side("a").join(side("b"), ["br", "bc"]).where("s_a < s_b and line_a != line_b")
    dra, dca, drb, dcb = (F.col(x) - F.col(y) for x, y in (("r2_a", "r1_a"), ("c2_a", "c1_a"), ("r2_b", "r1_b"), ("c2_b", "c1_b")))
    dr, dc = F.col("r1_b") - F.col("r1_a"), F.col("c1_b") - F.col("c1_a")
    hit = both.withColumn("den", dra * dcb - dca * drb).where(F.abs("den") >= 1e-12).withColumn("t", (dr * dcb - dc * drb) / F.col("den")).withColumn("u", (dr * dca - dc * dra) / F.col("den"))
    inner = lambda x: (F.col(x) > rules.eps) & (F.col(x) < 1 - rules.eps)
    hit = hit.where(inner("t") & inner("u") & (F.floor(F.col("r1_a") + dra * F.col("t")) == F.col("br")) & (F.floor(F.col("c1_a") + dca * F.col("t")) == F.col("bc")))
    za, zb = F.col("z1_a") + (F.col("z2_a") - F.col("z1_a")) * F.col("t"), F.col("z1_b") + (F.col("z2_b") - F.col("z1_b")) * F.col("u")
    hit = hit.where(~F.coalesce(F.abs(za - zb) > rules.z_tol, F.lit(False)))
    if meta is not None:
        hit = _same_level(hit, meta, F.col("line_a"), F.col("line_b"))
    return hit.select(F.col("s_a").alias("a"), F.col("s_b").alias("b"), "t", "u")


def _same_level(df: DataFrame, meta: DataFrame, one: Column, two: Column) -> DataFrame:
    side = lambda n: meta.select(F.col("line").alias(f"l{n}"), F.coalesce("deck", F.lit(False)).alias(f"d{n}"), F.coalesce("layer", F.lit(0)).alias(f"y{n}"))
    out = df.withColumn("l1", one).withColumn("l2", two).join(side(1), "l1", "left").join(side(2), "l2", "left")
    deck, layer = lambda n: F.coalesce(f"d{n}", F.lit(False)), lambda n: F.coalesce(f"y{n}", F.lit(0))
    return out.where(~((deck(1) | deck(2)) & (layer(1) != layer(2)))).drop("l1", "l2", "d1", "d2", "y1", "y2")


def t_junctions(vertices: DataFrame, seg: DataFrame, rules: Rules = Rules(), meta: DataFrame | None = None) -> DataFrame:
    """(s, t, line, seq, pr, pc): vertices that rest on the inside of another line's segment, within snap_tol. The cut is made
    at the vertex, so that both snap to one node."""
    z = F.col("z").cast("double") if "z" in vertices.columns else F.lit(None).cast("double")
    ends = vertices.select(F.col("line").alias("pl"), "seq", F.col("r").alias("pr"), F.col("c").alias("pc"), z.alias("pz"))
    lone = ends.groupBy("pl").agg(F.count("*").alias("n")).where("n >= 2").select("pl")
    # A vertex is put in the cells within reach; the point of the segment that is nearest to it lies in one of them.
    reach = F.lit(rules.snap_tol + COVER_EPS)
    span = lambda x: F.sequence(F.floor(F.col(x) - reach), F.floor(F.col(x) + reach))
    near = ends.join(lone, "pl").select("*", F.explode(span("pr")).alias("br")).select("*", F.explode(span("pc")).alias("bc"))
    both = near.join(_in_cells(seg), ["br", "bc"]).where("pl != line")
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    both = both.withColumn("t", ((F.col("pr") - F.col("r1")) * dr + (F.col("pc") - F.col("c1")) * dc) / (dr * dr + dc * dc)).where((F.col("t") > rules.eps) & (F.col("t") < 1 - rules.eps))
    qr, qc = F.col("r1") + dr * F.col("t"), F.col("c1") + dc * F.col("t")
    both = both.where((F.floor(qr) == F.col("br")) & (F.floor(qc) == F.col("bc")))
    both = both.where((F.col("pr") - qr) * (F.col("pr") - qr) + (F.col("pc") - qc) * (F.col("pc") - qc) <= rules.snap_tol * rules.snap_tol)
    both = both.where(~F.coalesce(F.abs(F.col("pz") - (F.col("z1") + (F.col("z2") - F.col("z1")) * F.col("t"))) > rules.z_tol, F.lit(False)))
    if meta is not None:
        both = _same_level(both, meta, F.col("pl"), F.col("line"))
    return both.select("s", "t", F.col("pl").alias("line"), "seq", "pr", "pc")


def planarize(vertices: DataFrame, rules: Rules = Rules(), meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (n, r, c), edges (a, b, s, arc_a, arc_b)): first-seen coordinates name a node, the first edge of a pair stays."""
    seg = written(segments(vertices), "segments")
    none = [F.lit(None).cast("double").alias(c) for c in ("pr", "pc")]
    cuts = seg.select("s", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), *none)
    if rules.crossings:
        sides = F.explode(F.array(F.struct(F.col("a").alias("s"), "t"), F.struct(F.col("b").alias("s"), F.col("u").alias("t"))))
        cuts = cuts.union(crossings(seg, rules, meta).select(sides.alias("x")).select("x.s", "x.t", *none))
        cuts = cuts.union(t_junctions(vertices, seg, rules, meta).select("s", "t", "pr", "pc"))
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    at = cuts.join(seg, "s").select("s", "t", F.coalesce("pr", F.col("r1") + dr * F.col("t")).alias("r"), F.coalesce("pc", F.col("c1") + dc * F.col("t")).alias("c"), (F.col("arc") + F.col("t") * F.sqrt(dr * dr + dc * dc)).alias("arc"), F.col("line"))
    by = Window.partitionBy("s").orderBy("t", "r", "c")
    parts = at.select("s", "line", "t", "r", "c", "arc", *[F.lead(x).over(by).alias(f"{x}2") for x in ("t", "r", "c", "arc")]).where(F.col("t2").isNotNull() & (F.col("t2") - F.col("t") >= rules.eps))
    parts = parts.select("s", "line", "t", "r", "c", "arc", "r2", "c2", "arc2", node_key(F.col("r"), F.col("c"), rules.snap_tol).alias("a"), node_key(F.col("r2"), F.col("c2"), rules.snap_tol).alias("b"))
    # Nodes and edges both come from the parts, so crossings and junctions are found once.
    parts = written(parts, "parts")
    seen = parts.select(F.col("a").alias("n"), F.struct("s", "t", F.lit(0).alias("end"), "r", "c").alias("x")).union(parts.select(F.col("b").alias("n"), F.struct("s", "t", F.lit(1).alias("end"), F.col("r2").alias("r"), F.col("c2").alias("c"))))
    nodes = seen.groupBy("n").agg(F.min("x").alias("x")).select("n", F.col("x.r").alias("r"), F.col("x.c").alias("c"))
    first = parts.where("a != b").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("s", "t", "a", "b", "arc", "arc2", "line")).alias("x"))
    edges = first.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.s").alias("s"), F.col("x.line").alias("line"), F.col("x.arc").alias("arc_a"), F.col("x.arc2").alias("arc_b"))
    return nodes, edges


def valid_nodes(nodes: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Nodes inside the grid on an unmasked cell."""
    inside = nodes.where((F.floor("r") >= 0) & (F.floor("r") < grid.rows) & (F.floor("c") >= 0) & (F.floor("c") < grid.cols)).withColumn("i", F.floor("r") * grid.cols + F.floor("c"))
    return inside.join(cells.where("m").select("i"), "i", "left_semi").select("n", "r", "c")


def profiles(nodes: DataFrame, edges: DataFrame, cells: DataFrame, grid: Grid, rules: Rules = Rules(), decks: DataFrame | None = None) -> DataFrame:
    """(a, b, len_m, step_m, prof): heights along each edge at equal steps. decks (line, h0, h1, total) are straight."""
    side = lambda n: nodes.select(F.col("n").alias(n), F.col("r").alias(f"r{n}"), F.col("c").alias(f"c{n}"))
    own = edges.join(side("a"), "a").join(side("b"), "b")
    dr, dc = F.col("rb") - F.col("ra"), F.col("cb") - F.col("ca")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dr * dr + dc * dc) / rules.step_cells).cast("int"))
    lm = F.sqrt(dr * grid.dy * (dr * grid.dy) + dc * grid.dx * (dc * grid.dx))
    sized = own.select("*", n.alias("n"), lm.alias("len_m"))
    points = sized.select("a", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("j"), "ra", "ca", dr.alias("dr"), dc.alias("dc")).select(F.struct("a", "b", "j").alias("p"), (F.col("ra") + F.col("dr") * (F.col("j") / F.col("n"))).alias("r"), (F.col("ca") + F.col("dc") * (F.col("j") / F.col("n"))).alias("c"))
    heights = raster.sample(points, cells, grid).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("p.j").alias("j"), F.col("height").cast("float").alias("h")))), lambda x: x["h"].cast("double")).alias("prof"))
    out = sized.join(heights, ["a", "b"]).select("a", "b", "line", "arc_a", "arc_b", "n", "len_m", (F.col("len_m") / F.col("n")).alias("step_m"), "prof")
    if decks is not None:
        out = out.join(decks, "line", "left")
        deck = lambda arc: F.col("h0") + (F.col("h1") - F.col("h0")) * (F.col(arc) / F.col("total"))
        straight = F.transform(F.sequence(F.lit(0), F.col("n")), lambda j: deck("arc_a") + (deck("arc_b") - deck("arc_a")) * (j / F.col("n")))
        out = out.withColumn("prof", F.when(F.col("h0").isNotNull(), straight).otherwise(F.col("prof")))
    return out.select("a", "b", "len_m", "step_m", "prof")


def deck_lines(vertices: DataFrame, meta: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(line, h0, h1, total): a deck's end heights, those told (ele_a, ele_b) before those of the ground, and its length."""
    own = vertices.join(meta.where("deck").select("line", "ele_a", "ele_b"), "line")
    ends = own.groupBy("line").agg(F.min(F.struct("seq", "r", "c")).alias("a"), F.max(F.struct("seq", "r", "c")).alias("b"), F.first("ele_a").alias("ele_a"), F.first("ele_b").alias("ele_b"))
    points = ends.select(F.struct("line", F.lit(0).alias("e")).alias("p"), F.col("a.r").alias("r"), F.col("a.c").alias("c")).union(ends.select(F.struct("line", F.lit(1).alias("e")), F.col("b.r"), F.col("b.c")))
    ground = raster.sample(points, cells, grid).groupBy(F.col("p.line").alias("line")).agg(F.max(F.when(F.col("p.e") == 0, F.col("height"))).alias("g0"), F.max(F.when(F.col("p.e") == 1, F.col("height"))).alias("g1"))
    length = segments(own).groupBy("line").agg(F.sum(F.sqrt((F.col("r2") - F.col("r1")) * (F.col("r2") - F.col("r1")) + (F.col("c2") - F.col("c1")) * (F.col("c2") - F.col("c1")))).alias("total"))
    told = lambda x, g: F.coalesce(F.when(F.isnan(x), None).otherwise(F.col(x)), g)
    return ends.join(ground, "line").join(length, "line").select("line", told("ele_a", "g0").alias("h0"), told("ele_b", "g1").alias("h1"), "total")


def directed_costs(profile: DataFrame, cost: Cost) -> DataFrame:
    """(a, b, len_m, ab, ba): every step is costed by itself, since the floor on descents isn't linear."""

    def total(forward: bool) -> Column:
        step = lambda j: F.col("prof")[j] - F.col("prof")[j - 1] if forward else F.col("prof")[j - 1] - F.col("prof")[j]
        order = F.sequence(F.lit(1), F.size("prof") - 1) if forward else F.sequence(F.size("prof") - 1, F.lit(1), F.lit(-1))
        return F.aggregate(order, F.lit(0.0), lambda acc, j: acc + edge_cost(F.col("step_m"), step(j), cost))

    return profile.select("a", "b", "len_m", total(True).alias("ab"), total(False).alias("ba"))


def half_edges(costs: DataFrame, valid: DataFrame) -> DataFrame:
    """(u, v, w) between valid nodes, both ways."""
    both = costs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("ab").alias("w")).union(costs.select("b", "a", "ba"))
    ok = lambda n: valid.select(F.col("n").alias(n))
    return both.join(ok("u"), "u", "left_semi").join(ok("v"), "v", "left_semi").select("u", "v", "w")


def edge_energy(costs: DataFrame, field: DataFrame) -> DataFrame:
    """(k, a, b, e): the mean of an edge's ends, or the one that is reached."""
    side = lambda n: field.select("k", F.col("i").alias(n), F.col("e").alias(f"e{n}"))
    keys = costs.select("a", "b")
    ks = keys.join(field.select("k", F.col("i").alias("a")), "a").select("k", "a", "b").union(keys.join(field.select("k", F.col("i").alias("b")), "b").select("k", "a", "b")).distinct()
    out = ks.join(side("a"), ["k", "a"], "left").join(side("b"), ["k", "b"], "left")
    return out.select("k", "a", "b", F.coalesce((F.col("ea") + F.col("eb")) / 2, "ea", "eb").alias("e"))


def edge_passes(costs: DataFrame, tree: DataFrame) -> DataFrame:
    """(k, a, b, passes): a child's subtree counts for the edge to its parent."""
    used = tree.where("parent is not null").groupBy("k", F.least("i", "parent").alias("x"), F.greatest("i", "parent").alias("y")).agg(F.sum("passes").alias("passes"))
    keyed = costs.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return keyed.join(used, ["x", "y"]).select("k", "a", "b", "passes")


def legs(half: DataFrame, costs: DataFrame, seeds: DataFrame, leg: str, e_max: float = 0.0, total: bool = False) -> tuple[DataFrame, DataFrame]:
    """(field (k, i, e), passes (k, a, b, passes)) of one direction or of a round trip, whose edges carry both legs' subtrees
    of nodes that both legs reach and the total allows."""
    from kelvora.operators import search, tree
    from kelvora.operators.grid import reversed_edges

    one = lambda e: search.written(search.tree(e, seeds, e_max), "tree")
    if leg != "round":
        own = one(half if leg == "from" else reversed_edges(half))
        return own.select("k", "i", "e"), edge_passes(costs, own)
    there, back = one(half), one(reversed_edges(half))
    both = written(search.round_trip(there.select("k", "i", "e"), back.select("k", "i", "e"), e_max if total else 0.0), "round")
    flows = [edge_passes(costs, tree.passes(x.select("k", "i", "e", "parent"), both)) for x in (there, back)]
    return both, flows[0].union(flows[1]).groupBy("k", "a", "b").agg(F.sum("passes").alias("passes"))


def _steps(path: DataFrame, costs: DataFrame, half: DataFrame) -> DataFrame:
    """(seq, a, b, len_m, w) of the edges of a path (seq, i) in the order of its search."""
    step = path.select("seq", F.col("i").alias("u")).join(path.select((F.col("seq") - 1).alias("seq"), F.col("i").alias("v")), "seq")
    keyed = costs.select("a", "b", "len_m", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return step.join(half.select("u", "v", "w"), ["u", "v"]).withColumn("x", F.least("u", "v")).withColumn("y", F.greatest("u", "v")).join(keyed, ["x", "y"]).select("seq", "a", "b", "len_m", "w")


def top_routes(half: DataFrame, costs: DataFrame, seed: int, goal: int, n: int, penalty: float, cost: Cost, e_max: float = 0.0, tiling=None) -> DataFrame:
    """(route, seq, i, energy, length_m, shared_edges): up to n routes, each sought with the edges of those before it dearer
    by (penalty**used - 1) times their flat cost. Energies are without penalties; shared_edges are the route's edges that
    any other route has, before or after it. half is the direction of the search, so routes to the seed are sought over
    reversed edges. The loop is over routes, at most a few."""
    from kelvora.operators import search, tree

    spark, penalty = half.sparkSession, max(1.0, penalty)
    seeds, goals = spark.createDataFrame([(0, seed)], "k bigint, i bigint"), spark.createDataFrame([(0, goal)], "k bigint, goal bigint")
    length = costs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "len_m")
    base = written(half.withColumn("x", F.least("u", "v")).withColumn("y", F.greatest("u", "v")).join(length, ["x", "y"]), "route-edges")
    used, rows = None, []
    for k in range(max(1, n)):
        now = base if used is None else base.join(used.groupBy("x", "y").agg(F.count("*").alias("times")), ["x", "y"], "left").withColumn("w", F.col("w") + (F.pow(F.lit(penalty), F.coalesce("times", F.lit(0))) - 1) * F.lit(cost.a_roll + cost.a_aero) * F.col("len_m"))
        grown = written(search.parents(now.select("u", "v", "w"), seeds, e_max, tiling) if tiling is not None else search.tree(now.select("u", "v", "w"), seeds, e_max), "route-tree")
        path = written(tree.path_to(grown, goals, tiling) if tiling is not None else tree.path(grown, goals), "route")
        steps = written(_steps(path, costs, half).withColumn("route", F.lit(k + 1)), "route-steps")
        if steps.limit(1).count() == 0:
            break
        rows.append((path.select(F.lit(k + 1).alias("route"), "seq", "i"), steps))
        own = steps.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "route")
        used = own if used is None else used.union(own)
    if not rows:
        return spark.createDataFrame([], "route int, seq int, i bigint, energy double, length_m double, shared_edges bigint")
    nodes, steps = rows[0]
    for p, q in rows[1:]:
        nodes, steps = nodes.union(p), steps.union(q)
    many = used.groupBy("x", "y").agg(F.count("*").alias("times")).where("times > 1")
    shared = used.join(many, ["x", "y"]).groupBy("route").agg(F.count("*").alias("shared_edges"))
    sums = steps.groupBy("route").agg(F.sum("w").alias("energy"), F.sum("len_m").alias("length_m")).join(shared, "route", "left")
    return nodes.join(sums, "route").select("route", "seq", "i", "energy", "length_m", F.coalesce("shared_edges", F.lit(0)).alias("shared_edges"))


def best_path(half: DataFrame, costs: DataFrame, seed: int, goal: int, e_max: float = 0.0, told: DataFrame | None = None) -> DataFrame:
    """(seq, i, energy, length_m) from the seed to the goal; energy is the goal's in told (k, i, e) where that is given, as a
    round trip's is more than that of its outward way."""
    from kelvora.operators import search, tree

    spark = half.sparkSession
    grown = written(search.tree(half, spark.createDataFrame([(0, seed)], "k bigint, i bigint"), e_max), "path-tree")
    path = written(tree.path(grown, spark.createDataFrame([(0, goal)], "k bigint, goal bigint")), "path")
    sums = _steps(path, costs, half).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("energy"), F.coalesce(F.sum("len_m"), F.lit(0.0)).alias("length_m")).withColumn("goal", F.lit(goal))
    if told is not None:
        sums = sums.drop("energy").join(told.where(F.col("i") == goal).select(F.col("i").alias("goal"), F.col("e").alias("energy")), "goal", "left")
    return path.join(sums, "goal").select("seq", "i", "energy", "length_m")


def burned(lines: DataFrame, cells: DataFrame, width: float) -> DataFrame:
    """(i) of the cells whose centre lies within half a width, in cells, of a polyline (line, seq, r, c), or that one passes."""
    seg, half_width = segments(lines), F.lit(width / 2)
    low, high = lambda a, b: F.floor(F.least(a, b) - half_width - 1), lambda a, b: F.floor(F.greatest(a, b) + half_width + 1)
    near = seg.select("r1", "c1", "r2", "c2", F.explode(F.sequence(low("r1", "r2"), high("r1", "r2"))).alias("r")).select("*", F.explode(F.sequence(low("c1", "c2"), high("c1", "c2"))).alias("c"))
    pr, pc, dr, dc = F.col("r") + 0.5, F.col("c") + 0.5, F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((pr - F.col("r1")) * dr + (pc - F.col("c1")) * dc) / (dr * dr + dc * dc)))
    qr, qc = F.col("r1") + dr * t - pr, F.col("c1") + dc * t - pc
    wide = near.where(qr * qr + qc * qc <= half_width * half_width).select("r", "c")
    passed = seg.select(F.explode(_covered()).alias("x")).select("x.r", "x.c")
    return cells.join(wide.union(passed).distinct(), ["r", "c"], "left_semi").select("i")


def snapped(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(p, i): the network cell whose centre is nearest to points (p, r, c), ties to the smaller cell."""
    return nearest(points, cells.where("m").select(F.col("i").alias("n"), (F.col("r") + 0.5).alias("r"), (F.col("c") + 0.5).alias("c"))).select("p", F.col("n").alias("i"))


def nearest(points: DataFrame, nodes: DataFrame, cell: float = 4.0) -> DataFrame:
    """(p, n, d2): the nearest node of points (p, r, c), ties to the smaller node. Buckets around a point are searched first;
    points that find nothing there, or nothing nearer than the buckets reach, widen their search until they do. Points whose
    place is null or not a number have none."""
    held = written(nodes.select("n", F.col("r").alias("nr"), F.col("c").alias("nc")), "nodes")
    left = points.where(F.coalesce(F.abs(F.col("r") + F.col("c")) < float("inf"), F.lit(False)) & ~F.isnan(F.col("r") + F.col("c"))).select("p", "r", "c")
    if held.limit(1).count() == 0:
        return left.limit(0).select("p", F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("d2"))
    out, reach = None, cell
    while True:
        at = lambda x, reach=reach: F.floor(F.col(x) / reach)
        near = left.withColumn("o", _around()).select("p", "r", "c", (at("r") + F.col("o.a")).alias("br"), (at("c") + F.col("o.b")).alias("bc"))
        dealt = held.withColumn("br", F.floor(F.col("nr") / reach)).withColumn("bc", F.floor(F.col("nc") / reach))
        d2 = (F.col("nr") - F.col("r")) * (F.col("nr") - F.col("r")) + (F.col("nc") - F.col("c")) * (F.col("nc") - F.col("c"))
        best = near.join(dealt, ["br", "bc"]).groupBy("p").agg(F.min(F.struct(d2.alias("d2"), "n")).alias("x")).where(F.col("x.d2") <= reach * reach)
        found = written(best.select("p", F.col("x.n").alias("n"), F.col("x.d2").alias("d2")), "nearest")
        out = found if out is None else out.union(found)
        left = written(left.join(found, "p", "left_anti"), "left")
        if left.limit(1).count() == 0:
            return out
        reach *= 8


def chained_decks(vertices: DataFrame, meta: DataFrame, decks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """deck_lines with simple chains of decks on one layer made one deck: (line, h0, h1, total).

    Decks that share an end are linked; a group of linked decks in which no end is shared by more than two and two are free is
    a chain. Only chains are walked, each by itself, from the smaller free end; every deck takes its part of the straight
    line. All other decks stay as they are, however many are linked."""
    ends = vertices.join(meta.where("deck").select("line", F.coalesce("layer", F.lit(0)).alias("layer")), "line").groupBy("line", "layer").agg(F.min(F.struct("seq", "r", "c")).alias("a"), F.max(F.struct("seq", "r", "c")).alias("b"))
    own = written(ends.select("line", "layer", node_key(F.col("a.r"), F.col("a.c"), rules.snap_tol).alias("na"), node_key(F.col("b.r"), F.col("b.c"), rules.snap_tol).alias("nb")).join(decks, "line"), "decks")
    at = own.select("layer", F.explode(F.array("na", "nb")).alias("n"), "line")
    ends_ = at.groupBy("layer", "n").agg(F.count("*").alias("shared"), F.min("line").alias("hub"))
    # Every deck at an end is linked with the smallest there, so links are as many as ends.
    label = components(at.join(ends_, ["layer", "n"]).select(F.col("line").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("n", "line").withColumnRenamed("label", "chain")
    held = written(own.join(label, "line"), "linked")
    shape = held.select("chain", "layer", F.explode(F.array("na", "nb")).alias("n")).join(ends_, ["layer", "n"]).groupBy("chain").agg(F.max("shared").alias("most"), F.sum((F.col("shared") == 1).cast("int")).alias("free"))
    told = held.join(shape, "chain").withColumn("walked", (F.col("most") == 2) & (F.col("free") == 2))

    def walk(key, group):
        import pandas as pd

        rows, at_ = group.to_dict("records"), {}
        for x in rows:
            for n in (x["na"], x["nb"]):
                at_.setdefault(n, []).append(x)
        node, before, chain = min(n for n, x in at_.items() if len(x) == 1), None, []
        while len(chain) < len(rows):
            x = next(x for x in at_[node] if x is not before)
            chain.append((x, x["na"] == node))
            node, before = x["nb"] if x["na"] == node else x["na"], x
        (x, fwd), (y, last) = chain[0], chain[-1]
        low, high, whole, arc, out = x["h0"] if fwd else x["h1"], y["h1"] if last else y["h0"], sum(c["total"] for c, _ in chain), 0.0, []
        for c, f in chain:
            p, q = low + (high - low) * arc / whole, low + (high - low) * (arc + c["total"]) / whole
            out.append((c["line"], p, q, c["total"]) if f else (c["line"], q, p, c["total"]))
            arc += c["total"]
        return pd.DataFrame(out, columns=["line", "h0", "h1", "total"])

    walked = told.where("walked").select("chain", "line", "na", "nb", "h0", "h1", "total").groupBy("chain").applyInPandas(walk, "line bigint, h0 double, h1 double, total double")
    return walked.union(told.where("not walked").select("line", "h0", "h1", "total"))
