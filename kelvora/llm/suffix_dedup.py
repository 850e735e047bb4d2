"""Removal of long strings that repeat, by sparse suffix arrays in a logarithmic index family.

A string of ``LENGTH`` bytes that stands in two places holds the same anchors in both: positions whose hash of the next
``GRAM`` bytes is the least of a window of ``LENGTH - GRAM + 1`` positions. Only suffixes at anchors are indexed, about
two in a window. An anchor's hull is all that the strings around it reach: up to ``LENGTH - GRAM`` bytes to its left and
``LENGTH`` to its right.

1. Anchors whose whole hull repeats are settled by counting hulls, with sums before the shuffle: copies and the inside
   of shared passages never go further, but for one of each.
2. The others whose gram repeats, at the edges of what is shared, are candidates: of the strings around an anchor, all that
   begin in one quarter of its reach have most of their bytes in common, and a hash of that part has to repeat too. They
   go with their hull's bytes to the index, dealt and sorted by gram. A gram's anchors go through a family of suffix
   arrays: a batch that comes in is sorted by what follows its anchors and by what precedes them, woven into every
   level by search, scanned there for strings of LENGTH bytes that both sides hold, and then levels of equal size are
   merged, so that n suffixes stand in about log(n) levels. Grams of few anchors share a batch.
3. A gram that more than ``GROUP`` hulls share is too much for one task's family, so it is split by its next bytes: the
   strings that begin in one piece of an anchor's reach have more bytes in common than the gram, and only anchors that
   agree on them can share a string there. Pieces that agree on all that they reach are settled by counting, but for one
   of each, as hulls are; pieces of at most GROUP anchors go through families of their own, and larger ones are split
   again, down to single strings, of which counting leaves nothing. So what a task holds is bounded at every skew.

The result is exact, up to collisions of hashes: 128 bits for hulls, 64 within a gram for pieces.

Defined results: a null text is empty; texts below LENGTH bytes lose nothing unless a string of LENGTH repeats, which
they can't hold; rows that repeat, with the same doc_id or not, are places of their own, so all of them lose what they
share; a text of any length is read whole; a table without rows gives none; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, shared_dir, table
from kelvora.llm.shingles import _BYTE, mix64, powers, slices, trimmed

LENGTH, GRAM = 400, 96
REACH = LENGTH - GRAM
#: A batch of the index, and what one family of it takes at most: some 30 MB.
BATCH_ROWS, GROUP = 4_096, 16_384
#: How many begins of strings a piece holds, split by split.
WIDTHS = (77, 20, 5, 1)
#: A string begins 0 to REACH bytes before its anchor: those of each quarter have LENGTH - QUARTER bytes in common.
QUARTER = REACH // 4


def _sliding(x: np.ndarray, width: int, take, fill: int) -> np.ndarray:
    """take over x[i : i + width], by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, fill)
        moved[: len(out) - step] = out[step:]
        take(out, moved, out=out)
        have += step
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) + 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(n)[: len(data)])]), powers(n, inverse=True)


def _hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of bytes a to b, whatever stands around them."""
    return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position, begin and stop of the hull within the row, hash of the gram, hash of the hull, hashes of the quarters'
    common parts: 0 where a text's end leaves none) of a slice."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none, np.zeros((0, 4), np.int32)
    sums, down = _sums(data)
    n = len(data)
    at = np.arange(n - GRAM + 1)
    gram = mix64((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1]) | np.uint64(1)
    end = np.repeat(offsets[1:], np.diff(offsets))  # of each byte's row
    top = np.iinfo(np.uint64).max
    h = np.where(at + GRAM <= end[at], gram, np.uint64(top))
    least = _sliding(h, REACH + 1, np.minimum, top)
    whole = np.where(at + LENGTH <= end[at], least, np.uint64(0))
    back = _sliding(whole[::-1].copy(), REACH + 1, np.maximum, 0)[::-1]
    pos = np.flatnonzero((back == h) & (h != top))
    row = np.searchsorted(offsets, pos, side="right") - 1
    begin, stop = np.maximum(pos - REACH, offsets[row]), np.minimum(pos + LENGTH, offsets[row + 1])
    hull = _hash(sums, down, begin, stop) ^ mix64((pos - begin).astype(np.uint64) + np.uint64(77))
    cores = np.zeros((len(pos), 4), np.int32)
    for q in range(4):
        a, b = pos - QUARTER * q, pos - QUARTER * (q + 1) + LENGTH
        fits = (a >= offsets[row]) & (b <= offsets[row + 1])
        cores[fits, q] = (_hash(sums, down, a[fits], b[fits]) >> np.uint64(32)).astype(np.uint32).view(np.int32) | 1
    return row, pos - offsets[row], begin - offsets[row], stop - offsets[row], gram[pos].view(np.int64), hull.view(np.int64), cores


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells rows of one doc_id apart, and the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")


def anchors(keyed: DataFrame) -> DataFrame:
    """Anchors of (doc_id, h, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(2)):
                row, pos, begin, stop, gram, hull, cores = anchors_of(data, offsets)
                if len(row):
                    own = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x, pa.int32()) for x in (pos, begin, stop)), pa.array(gram), pa.array(hull), *(pa.array(cores[:, q]) for q in range(4))],
                        ["doc_id", "h", "pos", "begin", "stop", "gram", "hull", "q0", "q1", "q2", "q3"],
                    )

    return keyed.mapInArrow(trimmed(find), "doc_id bigint, h bigint, pos int, begin int, stop int, gram bigint, hull bigint, q0 int, q1 int, q2 int, q3 int")


class Level:
    """A suffix array of anchors, and an array of what precedes them, both sorted, with what neighbours have in common;
    marks[i, d] says that the string which begins d bytes before anchor i stands elsewhere."""

    def __init__(self, right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, names: np.ndarray, marks: np.ndarray, sorted_: tuple | None = None):
        self.right, self.left, self.n_right, self.n_left, self.names, self.marks = right, left, n_right, n_left, names, marks
        (self.suffixes, self.common_right), (self.prefixes, self.common_left) = sorted_ or (_sorted(right), _sorted(left))

    def __len__(self) -> int:
        return len(self.names)

    def merged(self, new: Level) -> Level:
        """This level's rows, and then those of new."""
        both = [np.concatenate(x) for x in zip((self.right, self.left, self.n_right, self.n_left, self.names, self.marks), (new.right, new.left, new.n_right, new.n_left, new.names, new.marks), strict=True)]
        return Level(*both, sorted_=(_woven(both[0], self.suffixes, self.common_right, new.suffixes), _woven(both[1], self.prefixes, self.common_left, new.prefixes)))


def _bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in byte order, and what each has in common with the one before it."""
    order = np.argsort(_bytes(rows), kind="stable")
    return order, _common(rows, order, np.arange(len(order)))


def _woven(rows: np.ndarray, old: np.ndarray, common: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_sorted of rows, of which the first are sorted in old and the others in new: each of new is searched in old, and only
    rows that have another neighbour now are compared."""
    keys, n = _bytes(rows), len(old)
    at = np.searchsorted(keys[:n], keys[n:][new], side="right", sorter=old)
    order, common = np.insert(old, at, new + n), np.insert(common, at, 0)
    place = at + np.arange(len(new))
    fresh = np.union1d(place, place + 1)
    fresh = fresh[fresh < len(order)]
    common[fresh] = _common(rows, order, fresh)
    return order, common


def _common(rows: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of the prefix that the rows at these places of order share with the row before them; 0 for the first."""
    out = np.zeros(len(at), np.int32)
    for a in range(0, len(at), 4096):
        k = at[a : a + 4096]
        differ = rows[order[k]] != rows[order[k - 1]]
        out[a : a + 4096] = np.where(k == 0, 0, np.where(differ.any(1), differ.argmax(1), rows.shape[1]))
    return out


def scan(level: Level) -> None:
    """Mark the strings of LENGTH bytes that two anchors of a level share. For a string that begins d bytes before its
    anchor, anchors that share LENGTH - d bytes to the right are neighbours in one array and those that share d bytes
    to the left in the other; two that are in the same run of both hold it."""
    n = len(level)
    if n < 2:
        return
    sides = []
    for common, order, have in ((level.common_right, level.suffixes, level.n_right), (level.common_left, level.prefixes, level.n_left)):
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        near = np.maximum(common, np.append(common[1:], 0))[place]
        sides.append((common, place, np.minimum(near, have)))
    (common_r, place_r, near_r), (common_l, place_l, near_l) = sides
    low, high = LENGTH - near_r, np.minimum(near_l, REACH)
    some = np.flatnonzero(low <= high)
    if len(some) < 2:
        return
    low, high, place_r, place_l = low[some], high[some], place_r[some], place_l[some]
    for d in range(max(0, int(low.min())), int(high.max()) + 1):
        here = np.flatnonzero((low <= d) & (d <= high))
        if len(here) < 2:
            continue
        code = np.cumsum(common_r < LENGTH - d)[place_r[here]] * (n + 1) + np.cumsum(common_l < d)[place_l[here]]
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        hit = np.zeros(len(here), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        level.marks[some[here[hit]], d] = True


class Family:
    """Suffix arrays whose sizes are powers of two of a batch."""

    def __init__(self) -> None:
        self.levels: dict[int, Level] = {}

    def add(self, new: Level) -> None:
        if not self.levels:
            scan(new)
        for old in self.levels.values():
            both = old.merged(new)
            scan(both)
            old.marks |= both.marks[: len(old)]
            new.marks |= both.marks[len(old) :]
        size = 0
        while size in self.levels:
            new, size = self.levels.pop(size).merged(new), size + 1
        self.levels[size] = new


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, n = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(offsets)
    out = np.zeros((len(n), width), np.uint8)
    inside = np.arange(width) < n[:, None]
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, n


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of true values."""
    padded = np.zeros((marks.shape[0], marks.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marks
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


_RANGE = "gram bigint, hull bigint, first int, last int"


def _ranges(gram, hull, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(hull, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["gram", "hull", "first", "last"])


def _level(rows: list[pa.RecordBatch]) -> Level:
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    right, n_right = _matrix(batch.column(4), LENGTH)
    left, n_left = _matrix(batch.column(3), REACH)
    names = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
    return Level(right, left, n_right, n_left, names, np.zeros((len(names), REACH + 1), bool))


def _marked(family: Family) -> Iterator[pa.RecordBatch]:
    for level in family.levels.values():
        row, first, last = _runs(level.marks)
        if len(row):
            yield _ranges(level.names[row, 0], level.names[row, 1], first, last)


def _index(batch_rows: int):
    """Rows come in the order of their keys, and only anchors of one key share strings. So whole keys go through a family
    together up to batch_rows rows, and one that has more goes through a family of its own, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, n, first = Family(), [], 0, None

        def put() -> None:
            nonlocal held, n
            if n:
                family.add(_level(held))
                held, n = [], 0

        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if first is not None and keys[a] != first and (n + b - a > batch_rows or family.levels):
                    put()
                    yield from _marked(family)
                    family = Family()
                first = keys[a]
                for c in range(a, b, batch_rows):
                    d = min(b, c + batch_rows)
                    if n and n + d - c > batch_rows:
                        put()
                    held.append(batch.slice(c, d - c))
                    n += d - c
        put()
        yield from _marked(family)

    return run


def _contexts(keyed: DataFrame, reps: DataFrame) -> DataFrame:
    """(gram, hull, left reversed, right, hot) of one anchor of each hull."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1), strict=True):
                data, out = bytes(text.as_buffer()), places.values
                pos, begin, stop = (out.field(x).to_numpy() for x in ("pos", "begin", "stop"))
                yield pa.RecordBatch.from_arrays(
                    [
                        out.field("gram"),
                        out.field("hull"),
                        pa.array([data[b:p][::-1] for b, p in zip(begin, pos, strict=True)], pa.binary()),
                        pa.array([data[p:s] for p, s in zip(pos, stop, strict=True)], pa.binary()),
                        out.field("hot"),
                    ],
                    ["gram", "hull", "left", "right", "hot"],
                )

    by_doc = reps.groupBy(F.col("rep.doc_id").alias("doc_"), F.col("rep.h").alias("h_")).agg(F.collect_list(F.struct("gram", "hull", F.col("rep.pos").alias("pos"), F.col("rep.begin").alias("begin"), F.col("rep.stop").alias("stop"), "hot")).alias("places"))
    joined = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("h") == F.col("h_")))
    return joined.select("text", "places").mapInArrow(trimmed(_joined(cut)), "gram bigint, hull bigint, left binary, right binary, hot boolean")


def _joined(make, rows: int = 16_384):
    """make, with its small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in make(batches):
            held.append(batch)
            if sum(b.num_rows for b in held[-1:]) and (len(held) >= 256 or batch.num_rows >= rows):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _pieces(width: int):
    """For anchors, of which the strings that begin low to high bytes before them are asked for: pieces of so many begins
    (low, high), those that the text's ends leave (first, last), the hash of what a piece's strings have in common, and
    the hash of all that they reach. Where there is a string, what they have in common is there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, hull, left, right, low, high in zip(*(batch.column(k) for k in range(6)), strict=True):
                before = bytes(left.as_buffer())[::-1]
                data = np.frombuffer(before + bytes(right.as_buffer()), np.uint8)
                pos, (sums, down) = len(before), _sums(data)
                a = np.arange(low.as_py(), high.as_py() + 1, width)
                b = np.minimum(a + width - 1, high.as_py())
                first, last = np.maximum(a, LENGTH - (len(data) - pos)), np.minimum(b, min(pos, REACH))
                a, b, first, last = (x[first <= last] for x in (a, b, first, last))
                core = _hash(sums, down, pos - a, pos - b + LENGTH) ^ mix64((a * LENGTH + b).astype(np.uint64))
                whole = _hash(sums, down, pos - last, pos - first + LENGTH) ^ mix64((first * LENGTH + last).astype(np.uint64))
                n = len(a)
                out.append((np.full(n, gram.as_py()), np.full(n, hull.as_py()), a, b, first, last, core.view(np.int64), whole.view(np.int64)))
            if out:
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["gram", "hull", "low", "high", "first", "last", "core", "whole"])

    return run


#: What many hulls share is met in so many parts.
SALTS = 32


def _met(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows, with what is told of their keys, which have a row each and may be hot."""
    parts = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("hull", F.lit(SALTS)).cast("int")).join(parts, [*keys, "salt"], how).drop("salt")


def _split(contexts: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Rows for the index (key, gram, hull, left, right) of grams that are too much for a family, in groups of at most group
    rows, and _RANGE of what is settled on the way. There are at most as many rounds as WIDTHS."""
    todo, rows, settled = contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(REACH)), [], []
    for width in WIDTHS:
        pieces = todo.select("gram", "hull", "left", "right", "low", "high").mapInArrow(trimmed(_pieces(width)), "gram bigint, hull bigint, low int, high int, first int, last int, core bigint, whole bigint")
        pieces = materialise(pieces, "pieces")
        units = materialise(pieces.groupBy("gram", "low", "high", "core", "whole").agg(F.count("*").alias("n"), F.min("hull").alias("hull")), "units")
        settled.append(_met(pieces, units.where("n > 1").select("gram", "core", "whole", "low", "high"), ["gram", "core", "whole", "low", "high"]).select("gram", "hull", "first", "last"))
        groups = units.groupBy("gram", "low", "high", "core").agg(F.count("*").alias("many")).where("many > 1")
        alive = materialise(_met(units, groups, ["gram", "low", "high", "core"]).select("gram", "hull", "low", "high", F.xxhash64("gram", "core").alias("key"), "many"), "alive")
        rows.append(alive.where(F.col("many") <= group).select("gram", "hull", "low", "high", "key"))
        rest = alive.where(F.col("many") > group).select("gram", "hull", "low", "high")
        if rest.isEmpty():
            break
        todo = contexts.join(rest, ["gram", "hull"])
    few, done = rows[0], settled[0]
    for r, s in zip(rows[1:], settled[1:], strict=True):
        few, done = few.union(r), done.union(s)
    cut = contexts.join(few, ["gram", "hull"]).select("key", "gram", "hull", F.expr("substring(left, 1, high)").alias("left"), F.expr(f"substring(right, 1, {LENGTH} - low)").alias("right"))
    return cut, done


def _candidates(edges: DataFrame, group: int) -> DataFrame:
    """Hulls one of whose quarters has its common part in another hull of the same gram, too. Grams of more than group hulls
    are met in SALTS parts."""
    hot = F.col("hulls") > group
    cores = edges.select("gram", "hull", hot.alias("hot"), F.posexplode(F.array("rep.q0", "rep.q1", "rep.q2", "rep.q3")).alias("q", "core")).where("core != 0")
    twice = cores.groupBy("gram", "hot", "q", "core").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.select("gram", "q", "core", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
    own = cores.withColumn("salt", F.when(F.col("hot"), F.pmod("hull", F.lit(SALTS)).cast("int")).otherwise(0))
    fine = own.join(twice, ["gram", "q", "core", "salt"]).select("gram", "hull").distinct()
    return materialise(edges.join(fine, ["gram", "hull"]).select("gram", "hull", "rep", hot.alias("hot")), "edges")


def repeated(docs: DataFrame, batch_rows: int = BATCH_ROWS, group: int = GROUP) -> DataFrame:
    """(doc_id, h, ranges array<struct<a, b>>): bytes to remove, per row of docs that has any; ranges may overlap."""
    keyed = _keyed(docs)
    return _repeated(anchors(keyed), keyed, batch_rows, group)


def _repeated(found: DataFrame, keyed: DataFrame, batch_rows: int, group: int) -> DataFrame:
    hulls = found.groupBy("gram", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "pos", "begin", "stop", "q0", "q1", "q2", "q3")).alias("rep"))
    grams = hulls.groupBy("gram").agg(F.count("*").alias("hulls")).where("hulls > 1")
    told = _met(hulls, grams, ["gram"], "left").select("gram", "hull", "n", "rep", F.coalesce("hulls", F.lit(1)).alias("hulls"))
    groups = materialise(told.where("n > 1 or hulls > 1"), "hulls")
    edges = _candidates(groups.where("hulls > 1"), group)
    hot = not edges.where("hot").isEmpty()
    contexts = _contexts(keyed, edges)
    contexts = materialise(contexts, "contexts") if hot else contexts
    rows, settled = contexts.where("not hot").select(F.col("gram").alias("key"), "gram", "hull", "left", "right"), None
    if hot:
        split, settled = _split(contexts.where("hot").select("gram", "hull", "left", "right"), group)
        rows = rows.union(split)
    ranges = rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_index(batch_rows)), _RANGE)
    ranges = ranges.union(settled) if hot else ranges
    marks = ranges.groupBy("gram", "hull").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    full = groups.where("n > 1").select("gram", "hull", F.lit(True).alias("full"))
    settled = materialise(full.join(marks, ["gram", "hull"], "full"), "marks")
    at = found.join(settled, ["gram", "hull"])
    whole = F.when(F.col("full") & (F.col("stop") - F.col("begin") >= LENGTH), F.array(F.struct(F.col("begin").alias("a"), F.col("stop").alias("b"))))
    part = F.transform("runs", lambda r: F.struct((F.col("pos") - r["last"]).cast("int").alias("a"), (F.col("pos") - r["first"] + LENGTH).cast("int").alias("b")))
    return at.select("doc_id", "h", F.explode(F.coalesce(whole, part)).alias("r")).groupBy("doc_id", "h").agg(F.collect_list("r").alias("ranges"))


class Index:
    """Long strings of documents that come in batches: a logarithmic family of written levels.

    A level is two tables in the shared folder, the batch's texts and its anchors in the order of their grams. ``add`` meets
    a new batch's anchors with those of every level that have one of its grams, finds what repeats among them, and writes
    the batch as a level; two levels of one size class are then merged into one of the next, so that n anchors stand in
    about log2(n / LEVEL_ROWS) levels and each is rewritten as often at most. ``levels`` is all that has to be kept to go
    on with an index in another session."""

    LEVEL_ROWS = 1 << 20

    def __init__(self, spark, levels: dict[int, tuple[str, str]] | None = None, batch_rows: int = BATCH_ROWS, group: int = GROUP):
        self.spark, self.levels, self.batch_rows, self.group = spark, dict(levels or {}), batch_rows, group

    def _read(self, level: int) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.parquet(x) for x in self.levels[level])

    def _write(self, texts: DataFrame, found: DataFrame) -> tuple[str, str]:
        folder = shared_dir(self.spark)
        paths = tuple(f"{folder}/level-{name}-{uuid.uuid4().hex}" for name in ("texts", "anchors"))
        texts.write.parquet(paths[0])
        found.repartition("gram", "hull").sortWithinPartitions("gram").write.parquet(paths[1])
        return paths

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, h, ranges) as of ``repeated``, for rows of docs and of earlier batches: what has to go because it stands
        in docs and elsewhere. An earlier document's ranges are those that this batch adds."""
        texts = materialise(_keyed(docs), "batch")
        found = materialise(anchors(texts), "anchors")
        grams = found.select("gram").distinct()
        near, whole = found, texts
        for level in sorted(self.levels):
            old_texts, old = self._read(level)
            near, whole = near.union(old.join(grams, "gram", "left_semi").select(*found.columns)), whole.union(old_texts)
        out = materialise(_repeated(near, whole, self.batch_rows, self.group), "repeats")
        size, new = found.count(), (texts, found)
        at = max(0, (max(1, size) // self.LEVEL_ROWS).bit_length())
        while at in self.levels:
            old_texts, old = self._read(at)
            new = (new[0].union(old_texts), new[1].union(old.select(*found.columns)))
            del self.levels[at]
            at += 1
        self.levels[at] = self._write(*new)
        return out


def _spans(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def apply(docs: DataFrame, batch_rows: int = BATCH_ROWS, group: int = GROUP) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256), a row per row of docs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(*batch.columns, strict=True):
                data = bytes(text.as_buffer() or b"")
                spans = _spans(list(zip(ranges.values.field("a").to_pylist(), ranges.values.field("b").to_pylist(), strict=True))) if ranges.is_valid else []
                kept, last = [], 0
                for a, b in spans:
                    kept.append(data[last:a])
                    last = b
                left = b"".join([*kept, data[last:]])
                rows.append((doc_id.as_py(), left, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
                if len(rows) >= 1000:
                    yield _out(rows)
                    rows = []
            if rows:
                yield _out(rows)

    told = repeated(docs, batch_rows, group).withColumnRenamed("doc_id", "doc_").withColumnRenamed("h", "h_")
    joined = _keyed(docs).join(told, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("h") == F.col("h_")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(trimmed(cut), "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and text: the remaining bytes as text, with a mark where a cut has parted a character."""
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return apply(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)
