"""Canonical inputs for the queries, derived from the star-schema tables with exactly representable arithmetic, as Spark
frames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvora.functions.cost import DEFAULT, Cost
from kelvora.operators.grid import Grid
from kelvora.operators.moves import Move, build_moves

COLS = 50
DX = DY = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terrain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """(cells (i, r, c, h, m), grid) from part. Cells are never broadcast: their file is far smaller than their rows are on
    the driver."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), "p_size").hint("merge")
    n = part.agg(F.max("i")).first()[0] + 1
    r, c = F.floor(F.col("i") / COLS).cast("int"), F.pmod("i", F.lit(COLS)).cast("int")
    h = 700 + 0.5 * F.abs(F.pmod(r * 3, F.lit(40)) - 20) + 0.5 * F.abs(F.pmod(c * 5, F.lit(60)) - 30) + F.pmod(F.col("i") * 7919, F.lit(1009)) / 1024.0
    return part.select("i", r.alias("r"), c.alias("c"), h.cast("float").alias("h"), (F.col("p_size") != 50).alias("m")), Grid(-(-n // COLS), COLS, DX, DY)


def refs(spark: SparkSession, sf_dir: str, cells: DataFrame, grid: Grid) -> DataFrame:
    """(k, i): the suppliers' cells; those on masked cells are dropped, the others keep their number."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.pmod(F.col("s_suppkey") * 17, F.lit(grid.rows * grid.cols)).alias("i"))
    return own.join(cells.where("m").select("i"), "i", "left_semi").select("k", "i")


def first_seed(cells: DataFrame) -> DataFrame:
    return cells.where("m").agg(F.min("i").alias("i")).select(F.lit(0).cast("long").alias("k"), "i")


def lines(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """(line, seq, r, c): every order as a polyline of its items around a cell of its own, in sixteenths of a cell."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_suppkey").alias("x"), F.pmod(F.col("l_orderkey") * 37, F.lit(grid.rows * grid.cols)).alias("i"))
    r = F.floor(F.col("i") / COLS) + F.pmod(F.col("x") * 5 + F.col("seq") * 3, F.lit(17)) * 0.0625
    c = F.pmod("i", F.lit(COLS)) + F.pmod(F.col("x") * 3 + F.col("seq") * 7, F.lit(17)) * 0.0625
    return own.select("line", "seq", r.alias("r"), c.alias("c")).groupBy("line", "seq").agg(F.min("r").alias("r"), F.min("c").alias("c"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, seq, d, dh): an order's lines as segments of whole metres and quarter-metre rises."""
    own = table(spark, sf_dir, "lineitem")
    return own.groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("seq")).agg(F.min(F.col("l_quantity") * 8.0 + 20.0).alias("d"), F.min(F.pmod(F.col("l_partkey"), F.lit(41)) * 0.25 - 5.0).alias("dh"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts")


def moves(n: int = 8) -> list[Move]:
    return build_moves(n, DX, DY)


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def lit(x: float) -> str:
    """A double in SQL: with an exponent, so that it isn't read as a decimal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


CELL = f"""cell AS MATERIALIZED (
  SELECT i, r, c, CAST(700 + 0.5e0 * abs((r * 3) % 40 - 20) + 0.5e0 * abs((c * 5) % 60 - 30) + ((i * 7919) % 1009) / 1024e0 AS FLOAT)::DOUBLE AS h, m
  FROM (SELECT p_partkey AS i, p_partkey // {COLS} AS r, p_partkey % {COLS} AS c, p_size <> 50 AS m FROM part)
), dim AS MATERIALIZED (SELECT (max(i) + {COLS}) // {COLS} AS h, {COLS} AS w, ((max(i) + {COLS}) // {COLS}) * {COLS} AS n FROM cell)"""
REF = f"""ref AS MATERIALIZED (
  SELECT s_suppkey AS k, (s_suppkey * 17) % (SELECT n FROM dim) AS i FROM supplier
  WHERE (s_suppkey * 17) % (SELECT n FROM dim) IN (SELECT i FROM cell WHERE m)
)"""
SEED = "seed AS MATERIALIZED (SELECT 0::BIGINT AS k, min(i) AS i FROM cell WHERE m)"
LINES = f"""vert AS MATERIALIZED (
  SELECT line, seq, min(r) AS r, min(c) AS c FROM (
    SELECT line, seq, i // {COLS} + (x * 5 + seq * 3) % 17 * 0.0625e0 AS r, i % {COLS} + (x * 3 + seq * 7) % 17 * 0.0625e0 AS c
    FROM (SELECT l_orderkey AS line, l_linenumber::BIGINT AS seq, l_suppkey AS x, (l_orderkey * 37) % (SELECT n FROM dim) AS i FROM lineitem)
  ) GROUP BY line, seq
)"""
PROFILES = """pseg AS MATERIALIZED (
  SELECT l_orderkey AS track, l_linenumber::BIGINT AS seq, min(l_quantity * 8e0 + 20e0) AS d, min(l_partkey % 41 * 0.25e0 - 5e0) AS dh
  FROM lineitem GROUP BY 1, 2
)"""


def cost_sql(dist: str, dh: str, cost: Cost = DEFAULT) -> str:
    eps = f"greatest(0e0, least(1e0, {lit(cost.ab_ratio)} * ({dist}) / (-({dh}))) - {lit(cost.eps_offset)})"
    up = f"{lit(cost.a_roll)} * ({dist}) + CASE WHEN ({dh}) < {lit(cost.climb_thr)} * ({dist}) THEN {lit(cost.a_aero)} * ({dist}) ELSE 0e0 END + {lit(cost.beta)} * ({dh})"
    down = f"{lit(cost.a_roll)} * ({dist}) + {lit(cost.a_aero)} * ({dist}) - {eps} * {lit(cost.beta)} * (-({dh}))"
    return f"(CASE WHEN ({dh}) >= 0 THEN {up} ELSE greatest(0e0, {down}) END)"


def move_rows(n: int = 8) -> str:
    return ", ".join(f"({m.k}, {m.dr}, {m.dc}, {lit(m.dist)})" for m in moves(n) if not m.is_long)


def pairs_sql(n: int = 8, name: str = "nb") -> str:
    rows = move_rows(n)
    return f"""{name} AS MATERIALIZED (
  SELECT a.i AS u, b.i AS v, mv.k, mv.dist, a.h AS hu, b.h AS hv
  FROM cell a, (VALUES {rows}) mv(k, dr, dc, dist), cell b WHERE b.r = a.r + mv.dr AND b.c = a.c + mv.dc AND a.m AND b.m
)"""


def edges_sql(n: int = 8, cost: Cost = DEFAULT) -> str:
    """nb and edge(u, v, k, w, is_long)."""
    unit = f"SELECT u, v, k, {cost_sql('dist', 'hv - hu', cost)} AS w, false AS is_long FROM nb"
    long_ = [m for m in moves(n) if m.is_long]
    if not long_:
        return f"{pairs_sql(n)}, edge AS MATERIALIZED ({unit})"
    rows = ", ".join(f"({m.k}, {m.dr}, {m.dc}, {lit(m.dist / m.steps)}, {m.steps}, {s}, {a}, {b}, {lit(tr)}, {lit(tc)})" for m in long_ for s, a, b, tr, tc in m.samples)
    return f"""{pairs_sql(n)}, smp AS MATERIALIZED (
  SELECT a.i AS u, t.i AS v, mv.k, mv.sub, mv.n, mv.s, a.h AS hu, t.h AS hv,
    c0.h * (1 - mv.tr) * (1 - mv.tc) + c1.h * (1 - mv.tr) * mv.tc + c2.h * mv.tr * (1 - mv.tc) + c3.h * mv.tr * mv.tc AS hs
  FROM cell a, (VALUES {rows}) mv(k, dr, dc, sub, n, s, oa, ob, tr, tc), cell t, cell c0, cell c1, cell c2, cell c3
  WHERE a.m AND t.m AND t.r = a.r + mv.dr AND t.c = a.c + mv.dc AND c0.m AND c1.m AND c2.m AND c3.m
    AND c0.i = a.i + mv.oa * {COLS} + mv.ob AND c1.i = c0.i + 1 AND c2.i = c0.i + {COLS} AND c3.i = c0.i + {COLS} + 1
), prof AS (
  SELECT u, v, k, sub, list_prepend(any_value(hu), list_append(list(hs ORDER BY s), any_value(hv))) AS p
  FROM smp GROUP BY u, v, k, sub, n HAVING count(*) = n - 1
), edge AS MATERIALIZED (
  {unit} UNION ALL
  SELECT u, v, k, list_reduce(list_transform(range(2, len(p) + 1), lambda j: {cost_sql('sub', 'p[j] - p[j - 1]', cost)}), lambda x, y: x + y, 0e0) AS w, true FROM prof
)"""


def field_sql(name: str, seed: str, edge: str = "edge", e_max: float = 0.0, flip: bool = False) -> str:
    """name(k, n, dist): a recursive table keyed by seed and node."""
    u, v = ("v", "u") if flip else ("u", "v")
    cap = f"AND d.dist + w.w <= {lit(e_max)}" if e_max > 0 else ""
    return f"""{name}(k, n, dist) USING KEY (k, n) AS (
  SELECT k, i, 0e0 FROM {seed}
  UNION
  SELECT d.k, w.{v}, min(d.dist + w.w) FROM {name} d JOIN {edge} w ON d.n = w.{u}
  LEFT JOIN recurring.{name} q ON q.k = d.k AND q.n = w.{v}
  WHERE (q.dist IS NULL OR d.dist + w.w < q.dist) {cap} GROUP BY d.k, w.{v}
)"""


def tree_sql(name: str, field: str, seed: str, edge: str = "edge", flip: bool = False) -> str:
    """name(k, i, e, parent), its closure name_up(k, i, anc, hops) and name_pass(k, i, passes, depth)."""
    u, v = ("v", "u") if flip else ("u", "v")
    return f"""{name} AS MATERIALIZED (
  SELECT f.k, f.n AS i, f.dist AS e, CASE WHEN f.n = s.i THEN NULL ELSE p.parent END AS parent
  FROM {field} f JOIN {seed} s ON s.k = f.k LEFT JOIN (
    SELECT g.k, w.{v} AS i, arg_min(w.{u}, (g.dist + w.w, w.{u})) AS parent FROM {field} g JOIN {edge} w ON w.{u} = g.n GROUP BY g.k, w.{v}
  ) p ON p.k = f.k AND p.i = f.n
), {name}_up(k, i, anc, hops) AS (
  SELECT k, i, i, 0 FROM {name}
  UNION ALL
  SELECT a.k, a.i, t.parent, a.hops + 1 FROM {name}_up a JOIN {name} t ON t.k = a.k AND t.i = a.anc WHERE t.parent IS NOT NULL
), {name}_pass AS MATERIALIZED (
  SELECT c.k, c.i, c.passes, d.depth FROM (SELECT k, anc AS i, count(*)::DOUBLE AS passes FROM {name}_up GROUP BY k, anc) c
  JOIN (SELECT k, i, max(hops) AS depth FROM {name}_up GROUP BY k, i) d ON d.k = c.k AND d.i = c.i
)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + "\n"
