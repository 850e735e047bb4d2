"""Lines of fewer vertices, and geometries in their multiple forms.

Douglas-Peucker keeps a line's ends and, where a vertex between them is farther than tol from their chord, the farthest, and
then does the same on both sides of it. Of vertices equally far the one nearest the middle is taken, by seq, and of two such
the first, so that a regular line falls into halves. Sides don't depend on each other, so a line of any length is cut at its
farthest vertex in rounds over the whole table, until no part has more than ``PIECE`` vertices; tasks finish the parts, many
at a time as arrays. The rows are those of the plain recursion.

Defined results: vertices without a place are left out; a line of one or two vertices stays; a line that ends where it begins
stays as it was where fewer than four of its vertices would be left; a table without rows gives none. seq tells a line's
vertices apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvora.operators.search import written

#: Vertices of a line's part that one task finishes.
PIECE = 65_536
#: Vertices of one part that is still to be cut are met in so many groups.
SALTS = 32
_AT = "line bigint, seq bigint, r double, c double"


def apart(r, c, ar, ac, br, bc, t):
    """The square of the distance from (r, c) to the place at t of the way from (ar, ac) to (br, bc)."""
    x, y = r - (ar + t * (br - ar)), c - (ac + t * (bc - ac))
    return x * x + y * y


def _apart_column(a: str, b: str) -> Column:
    r, c, ar, ac, br, bc = (F.col(x) for x in ("r", "c", f"{a}.r", f"{a}.c", f"{b}.r", f"{b}.c"))
    length = (br - ar) * (br - ar) + (bc - ac) * (bc - ac)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((r - ar) * (br - ar) + (c - ac) * (bc - ac)) / length))).otherwise(F.lit(0.0))
    return apart(r, c, ar, ac, br, bc, t)


def kept(part: np.ndarray, seq: np.ndarray, r: np.ndarray, c: np.ndarray, tol: float) -> np.ndarray:
    """Which vertices stay. Rows of a part stand together, in order and with both ends; all parts are cut at once."""
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    a, b = first, np.append(first[1:], len(part)) - 1
    stays = np.zeros(len(part), bool)
    stays[a] = stays[b] = True
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            return stays
        size = b - a - 1
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(a)), size)
        i = np.arange(len(own)) - begin[own] + a[own] + 1
        ar, ac, br, bc = r[a][own], c[a][own], r[b][own], c[b][own]
        length = (br - ar) * (br - ar) + (bc - ac) * (bc - ac)
        along = (r[i] - ar) * (br - ar) + (c[i] - ac) * (bc - ac)
        t = np.clip(np.divide(along, length, out=np.zeros(len(i)), where=length > 0), 0.0, 1.0)
        d = apart(r[i], c[i], ar, ac, br, bc, t)
        far = np.maximum.reduceat(d, begin)
        hit = np.flatnonzero(d == far[own])
        off = np.abs(2 * seq[i[hit]] - seq[a][own[hit]] - seq[b][own[hit]])
        hit = hit[np.lexsort((i[hit], off, own[hit]))]
        middle = i[hit[np.unique(own[hit], return_index=True)[1]]]
        cut = far > tol * tol
        stays[middle[cut]] = True
        a, b = np.concatenate([a[cut], middle[cut]]), np.concatenate([middle[cut], b[cut]])


def _salted(spans: DataFrame) -> DataFrame:
    return spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def parts(own: DataFrame, tol: float, piece: int = PIECE) -> DataFrame:
    """(line, at, seq, r, c, again): lines in parts of at most piece vertices between their ends, at being where a part
    begins. A part's last vertex that is the next one's first says again."""
    place = F.struct("seq", "r", "c")
    spans = own.groupBy("line").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
    spans = written(spans.where(F.col("n") > piece + 2).select("line", F.col("a.seq").alias("at"), "a", "b", F.col("b.seq").alias("end")), "spans")
    if spans.isEmpty():
        return own.select("line", F.lit(0).cast("long").alias("at"), "seq", "r", "c", F.lit(False).alias("again"))
    keys, out = ["line", "at", "salt"], ["line", "at", "seq", "r", "c", "again"]
    salted = own.withColumn("salt", F.pmod("seq", F.lit(SALTS)).cast("int")).join(_salted(spans.select("line", "at", F.col("a.seq").alias("low"), F.col("b.seq").alias("high"))), ["line", "salt"], "left")
    salted = written(salted, "vertices")
    done = [salted.where("at is null").select("line", F.lit(0).cast("long").alias("at"), "seq", "r", "c", F.lit(False).alias("again"))]
    rest = salted.where("seq > low and seq < high").select(*keys, "seq", "r", "c")

    def ends(of: DataFrame) -> DataFrame:
        two = F.array(F.struct("a.*", F.lit(False).alias("again")), F.struct("b.*", (F.col("b.seq") < F.col("end")).alias("again")))
        return of.select("line", "at", F.explode(two).alias("x")).select("line", "at", "x.*")

    while not spans.isEmpty():
        told = rest.join(_salted(spans), keys).withColumn("d", _apart_column("a", "b"))
        far = told.groupBy("line", "at").agg(F.max(F.struct("d", (-F.abs(2 * F.col("seq") - F.col("a.seq") - F.col("b.seq"))).alias("off"), (-F.col("seq")).alias("back"), "r", "c")).alias("m"))
        met = written(spans.join(far, ["line", "at"]).withColumn("m", F.struct((-F.col("m.back")).alias("seq"), "m.r", "m.c", "m.d")), "farthest")
        done.append(ends(met.where(F.col("m.d") <= tol * tol)))
        cut = met.where(F.col("m.d") > tol * tol).withColumn("m", F.struct("m.seq", "m.r", "m.c"))
        sides = rest.join(_salted(cut.select("line", "at", F.col("m.seq").alias("middle"))), keys).where("seq != middle")
        sides = written(sides.select("line", F.when(F.col("seq") < F.col("middle"), F.col("at")).otherwise(F.col("middle")).alias("at"), "salt", "seq", "r", "c"), "sides")
        halves = cut.select("line", F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("x"), "end").select("line", F.col("x.a.seq").alias("at"), "x.a", "x.b", "end")
        sized = written(halves.join(sides.groupBy("line", "at").agg(F.count("*").alias("n")), ["line", "at"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "sized")
        small, spans = sized.where(F.col("n") <= piece), sized.where(F.col("n") > piece).drop("n")
        done += [ends(small), sides.join(_salted(small.select("line", "at")), keys).select("line", "at", "seq", "r", "c", F.lit(False).alias("again"))]
        rest = sides.join(_salted(spans.select("line", "at")), keys)
    return _union([x.select(*out) for x in done])


def simplify(vertices: DataFrame, tol: float, piece: int = PIECE) -> DataFrame:
    """The vertices (line, seq, r, c) that stay."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: pa.Table) -> list[pa.RecordBatch]:
            line, at, again = (rows.column(k).to_numpy() for k in (0, 1, 5))
            part = np.cumsum(np.append(True, (line[1:] != line[:-1]) | (at[1:] != at[:-1])))
            stays = kept(part, rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4).to_numpy(), tol) & ~again
            return rows.select([0, 2, 3, 4]).filter(pa.array(stays)).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            line, at = (batch.column(k).to_numpy() for k in (0, 1))
            own = np.flatnonzero((line != line[-1]) | (at != at[-1]))
            begin = int(own[-1]) + 1 if len(own) else 0  # of the part that the next batch may go on with
            if not begin and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (line[0], at[0]):
                held.append(batch)
                continue
            if held or begin:
                yield from told(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = [batch.slice(begin)]
        if held:
            yield from told(pa.Table.from_batches(held))

    own = vertices.select(F.col("line").cast("long").alias("line"), F.col("seq").cast("long").alias("seq"), F.col("r").cast("double").alias("r"), F.col("c").cast("double").alias("c")).where("line is not null and seq is not null and not isnan(r + c) and r + c is not null")
    cut = parts(own, tol, piece).repartition("line", "at").sortWithinPartitions("line", "at", "seq")
    out = written(cut.mapInArrow(finish, _AT), "kept")
    place = F.struct("seq", "r", "c")
    rings = out.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("n > 1 and n < 4 and a.r = b.r and a.c = b.c").select("line")
    return out.join(rings, "line", "left_anti").unionByName(own.join(rings, "line", "left_semi"))


def promote_to_multi(wkt: Column) -> Column:
    """A point, line or polygon in WKT as its multiple form; what is one already, or a collection, stays."""
    bare = r"(?is)^\s*(POINT|LINESTRING|POLYGON)\s*((?:ZM|Z|M)?)\s*"
    kind, dims = F.upper(F.regexp_extract(wkt, bare, 1)), F.upper(F.regexp_extract(wkt, bare, 2))
    body = F.trim(F.regexp_replace(wkt, bare, ""))
    head = F.concat(F.lit("MULTI"), kind, F.when(dims == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), dims, F.lit(" "))))
    return F.when(kind == "", wkt).when(F.upper(body) == "EMPTY", F.concat(head, F.lit("EMPTY"))).otherwise(F.concat(head, F.lit("("), body, F.lit(")")))
