"""FlatGeobuf: features in Hilbert order under a packed R-tree, written by tasks and read by boxes.

Writing: tasks encode features; they are sorted by the Hilbert number of their middles, and a feature's rank and place are
sums within its range and over the ranges. Each level of the tree is the level below, grouped by sixteens. Tasks put
features and nodes where they belong in one file under another name; the commit writes the head and names the file. Its
folder has to be one that driver and executors mount.

Reading: the driver follows the tree from its root only until it has enough nodes to deal out; each task goes on from its
own and reads just the nodes and features that meet the box, by byte ranges, from any store that pyarrow opens.

A geometry is (kind, parts): parts of rings of points. Points and lines are parts of one ring, polygons a part with its
holes after its outline; several of a kind are several parts.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kelvora.operators.search import written
from kelvora.sources.tiff import Read, listed_as, ranges

#: Fixed values of the format: its mark, geometry and column kinds, bytes of a node, children of a node.
MAGIC = b"fgb\x03fgb\x01"
KINDS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
COLUMNS = {"boolean": (2, "?"), "int": (5, "i"), "bigint": (7, "q"), "double": (10, "d"), "string": (11, "")}
NODE, FAN = struct.Struct("<4dQ"), 16
HILBERT_BITS = 16
#: Nodes that the driver deals out, and bytes that a task reads at once.
DEALT, RUN_BYTES = 64, 4 << 20
_GEOMETRY = "kind string, parts array<array<array<struct<x:double,y:double>>>>"
_SCHEMA = f"id bigint, {_GEOMETRY}, properties string"


class Buffer:
    """A size-prefixed table tree, written forwards: what a table refers to comes after it."""

    def __init__(self):
        self.data = bytearray(8)  # size, root

    def finish(self, fields: list) -> bytes:
        struct.pack_into("<I", self.data, 4, self.table(fields) - 4)
        struct.pack_into("<I", self.data, 0, len(self.data) - 4)
        return bytes(self.data)

    def pad(self, size: int, ahead: int = 0) -> None:
        self.data += bytes(-(len(self.data) + ahead) % size)

    def table(self, fields: list[tuple[int, str, object]]) -> int:
        """(number, code, value) of each field: a scalar's struct code, or t, T, s, d, I, B for a table, tables, a text,
        doubles, numbers, bytes."""
        own = sorted((f for f in fields if f[2] is not None), key=lambda f: -struct.calcsize(self._code(f[1])))
        n, at, places = max(f[0] for f in own) + 1, 4, {}
        for number, code, _ in own:
            size = struct.calcsize(self._code(code))
            at += -at % size
            places[number] = at
            at += size
        self.pad(2)
        marks = len(self.data)
        self.data += struct.pack(f"<HH{n}H", 4 + 2 * n, at, *(places.get(k, 0) for k in range(n)))
        self.pad(8)
        begin = len(self.data)
        self.data += struct.pack("<i", begin - marks) + bytes(at - 4)
        for number, code, value in own:
            here = begin + places[number]
            struct.pack_into("<" + self._code(code), self.data, here, self._put(code, value) - here if code[0] == "@" else value)
        return begin

    @staticmethod
    def _code(code: str) -> str:
        return "I" if code[0] == "@" else code

    def _put(self, code: str, value) -> int:
        if code == "@t":
            return self.table(value)
        if code == "@T":
            self.pad(4)
            begin = len(self.data)
            self.data += struct.pack("<I", len(value)) + bytes(4 * len(value))
            for k, fields in enumerate(value):
                here = begin + 4 + 4 * k
                struct.pack_into("<I", self.data, here, self.table(fields) - here)
            return begin
        raw = value.encode() if code == "@s" else bytes(value) if code == "@B" else np.asarray(value, "<f8" if code == "@d" else "<u4").tobytes()
        self.pad(8 if code == "@d" else 4, 4 if code == "@d" else 0)
        begin = len(self.data)
        self.data += struct.pack("<I", len(value) if code != "@s" else len(raw)) + raw + (b"\0" if code == "@s" else b"")
        return begin


class Table:
    """Reads a table of a buffer; a field that isn't there is its default."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.marks = at - struct.unpack_from("<i", data, at)[0]
        self.n = (struct.unpack_from("<H", data, self.marks)[0] - 4) // 2

    @classmethod
    def root(cls, data: bytes) -> Table:
        return cls(data, struct.unpack_from("<I", data)[0])

    def place(self, number: int) -> int:
        own = struct.unpack_from("<H", self.data, self.marks + 4 + 2 * number)[0] if number < self.n else 0
        return self.at + own if own else 0

    def scalar(self, number: int, code: str, default):
        at = self.place(number)
        return struct.unpack_from("<" + code, self.data, at)[0] if at else default

    def _list(self, number: int) -> tuple[int, int]:
        at = self.place(number)
        at += struct.unpack_from("<I", self.data, at)[0] if at else 0
        return (at + 4, struct.unpack_from("<I", self.data, at)[0]) if at else (0, 0)

    def numbers(self, number: int, kind: str) -> np.ndarray:
        at, n = self._list(number)
        return np.frombuffer(self.data, kind, n, at) if n else np.zeros(0, kind)

    def raw(self, number: int) -> bytes:
        at, n = self._list(number)
        return bytes(self.data[at : at + n])

    def tables(self, number: int) -> list[Table]:
        at, n = self._list(number)
        return [Table(self.data, at + 4 * k + struct.unpack_from("<I", self.data, at + 4 * k)[0]) for k in range(n)]

    def table(self, number: int) -> Table | None:
        at = self.place(number)
        return Table(self.data, at + struct.unpack_from("<I", self.data, at)[0]) if at else None


def _rings(rings: Sequence, kind: int | None) -> list:
    """A geometry table's fields of rings of points."""
    ends = np.cumsum([len(r) for r in rings])
    return [(0, "@I", ends if len(rings) > 1 else None), (1, "@d", [v for r in rings for p in r for v in (p["x"], p["y"])]), (6, "B", kind)]


def encoded(kind: str, parts: Sequence, properties: bytes) -> bytes:
    if kind == "MultiPolygon":
        geometry = [(6, "B", KINDS[kind]), (7, "@T", [_rings(p, KINDS["Polygon"]) for p in parts])]
    else:
        geometry = _rings([r for p in parts for r in p] if kind != "MultiPoint" else [[q for p in parts for r in p for q in r]], KINDS[kind])
    return Buffer().finish([(0, "@t", geometry), (1, "@B", properties or None)])


def decoded(data: bytes, columns: list[tuple[str, int]], kind: int = 0) -> tuple[str, list, dict]:
    """(kind, parts, properties) of a feature without its size."""
    feature = Table.root(data)
    geometry, name_of = feature.table(0), {v: k for k, v in KINDS.items()}
    kind = geometry.scalar(6, "B", 0) or kind

    def rings(t: Table) -> list:
        points = [{"x": float(a), "y": float(b)} for a, b in t.numbers(1, "<f8").reshape(-1, 2)]
        ends = t.numbers(0, "<u4").tolist() or [len(points)]
        return [points[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    name = name_of[kind]
    parts = [rings(t) for t in geometry.tables(7)] if name == "MultiPolygon" else [rings(geometry)] if name in ("Point", "LineString", "Polygon") else [[[p]] for p in rings(geometry)[0]] if name == "MultiPoint" else [[r] for r in rings(geometry)]
    raw, at, out, codes = feature.raw(1), 0, {}, {n: c for n, c in COLUMNS.values()}
    while at < len(raw):
        (number,) = struct.unpack_from("<H", raw, at)
        column, sort = columns[number]
        code = codes[sort]
        if code:
            out[column], at = struct.unpack_from("<" + code, raw, at + 2)[0], at + 2 + struct.calcsize("<" + code)
        else:
            (n,) = struct.unpack_from("<I", raw, at + 2)
            out[column], at = raw[at + 6 : at + 6 + n].decode(), at + 6 + n
    return name, parts, out


def node_bytes(*node: float) -> bytes:
    return NODE.pack(*node)


def levels(n: int) -> list[tuple[int, int]]:
    """(first node, nodes) of each level, leaves first; the root is node 0."""
    sizes = [n]
    while len(sizes) == 1 or sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    first, out = sum(sizes), []
    for s in sizes:
        first -= s
        out.append((first, s))
    return out


class Head:
    def __init__(self, read: Read):
        self.read = read
        first = read(0, 12)
        if first[:7] != MAGIC[:7]:
            raise ValueError("not a FlatGeobuf of version 3")
        (size,) = struct.unpack_from("<I", first, 8)
        table = Table.root(read(12, size))
        self.columns = [(c.raw(0).decode(), c.scalar(1, "B", 0)) for c in table.tables(7)]
        self.n, self.fan, self.kind = table.scalar(8, "Q", 0), table.scalar(9, "H", 16), table.scalar(2, "B", 0)
        if self.n and self.fan != FAN:
            raise ValueError(f"an index of {self.fan} children a node isn't read")
        self.index = 12 + size
        self.levels = levels(self.n) if self.n else []
        self.features = self.index + NODE.size * sum(s for _, s in self.levels)

    def below(self, level: int, nodes: Sequence[int], box: Sequence[float]) -> list[tuple[int, int]]:
        """(number in its level, offset) of nodes of a level, given by runs of numbers, that meet the box."""
        out, first = [], self.levels[level][0]
        for a, b in _runs(nodes):
            raw = self.read(self.index + NODE.size * (first + a), NODE.size * (b - a))
            for k, (x0, y0, x1, y1, offset) in enumerate(NODE.iter_unpack(raw)):
                if x0 <= box[2] and x1 >= box[0] and y0 <= box[3] and y1 >= box[1]:
                    out.append((a + k, offset))
        return out

    def children(self, level: int, nodes: Sequence[int]) -> list[int]:
        return [c for n in nodes for c in range(n * FAN, min((n + 1) * FAN, self.levels[level - 1][1]))]


def _runs(numbers: Sequence[int]) -> Iterator[tuple[int, int]]:
    begin = None
    for k, n in enumerate(numbers):
        begin = n if begin is None else begin
        if k + 1 == len(numbers) or numbers[k + 1] != n + 1:
            yield begin, n + 1
            begin = None


class Nodes(InputPartition):
    def __init__(self, path: str, level: int, numbers: list[int]):
        super().__init__((path, level))
        self.path, self.level, self.numbers = path, level, numbers


class FgbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.box = [float(options.get(k, d)) for k, d in (("x0", -math.inf), ("y0", -math.inf), ("x1", math.inf), ("y1", math.inf))]

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in listed_as(self.path, (".fgb",)):
            read, close = ranges(path)
            head = Head(read)
            level, nodes = len(head.levels) - 1, [0] if head.n else []
            while nodes:
                nodes = [n for n, _ in head.below(level, nodes, self.box)]
                if level == 0 or len(nodes) >= DEALT:
                    break
                level, nodes = level - 1, head.children(level, nodes)
            close()
            size = max(1, -(-len(nodes) // DEALT))
            out += [Nodes(path, level, nodes[k : k + size]) for k in range(0, len(nodes), size)]
        return out

    def read(self, partition: Nodes | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing meets the box
            return
        read, close = ranges(partition.path)
        head, nodes = Head(read), partition.numbers
        for level in range(partition.level, 0, -1):
            nodes = [n for n, _ in head.below(level - 1, head.children(level, nodes), self.box)]
        leaves = head.below(0, nodes, self.box)
        while leaves:
            n = 1  # features that follow one another are read together
            while n < len(leaves) and leaves[n][0] == leaves[n - 1][0] + 1 and leaves[n][1] - leaves[0][1] < RUN_BYTES:
                n += 1
            (begin, end), rows = (leaves[0][1], leaves[n - 1][1]), []
            raw = read(head.features + begin, end + 4 - begin)
            raw += read(head.features + end + 4, struct.unpack_from("<I", raw, end - begin)[0])
            for number, offset in leaves[:n]:
                (size,) = struct.unpack_from("<I", raw, offset - begin)
                kind, parts, properties = decoded(raw[offset - begin + 4 : offset - begin + 4 + size], head.columns, head.kind)
                rows.append((number, kind, parts, json.dumps(properties)))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "kind", "parts", "properties"])
            leaves = leaves[n:]
        close()


@dataclass
class Put(WriterCommitMessage):
    rows: int


class FgbWriter(DataSourceArrowWriter):
    """Puts rows (at, data) into one file; at counts from the end of the head."""

    def __init__(self, options: dict):
        self.path, self.head = options["path"].removeprefix("file://").removeprefix("file:"), bytes.fromhex(options["head"])
        self.work = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Put:
        file, n = os.open(self.work, os.O_CREAT | os.O_WRONLY, 0o644), 0
        for batch in iterator:
            for at, data in zip(batch.column(0), batch.column(1), strict=True):
                os.pwrite(file, data.as_py(), len(self.head) + at.as_py())
                n += 1
        os.fsync(file)
        os.close(file)
        return Put(n)

    def commit(self, messages: list[Put | None]) -> None:
        file = os.open(self.work, os.O_CREAT | os.O_WRONLY, 0o644)
        os.pwrite(file, self.head, 0)
        os.fsync(file)
        os.close(file)
        os.replace(self.work, self.path)

    def abort(self, messages: list[Put | None]) -> None:
        if os.path.exists(self.work):
            os.remove(self.work)


class FlatGeobuf(DataSource):
    """Options to read: path, x0, y0, x1, y1. To write, see ``write``."""

    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FgbReader:
        return FgbReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FgbWriter:
        return FgbWriter(dict(self.options))


def read(spark: SparkSession, path: str, box: Sequence[float] | None = None) -> DataFrame:
    """(id, kind, parts, properties as JSON) of the features whose boxes meet (x0, y0, x1, y1), or of all."""
    spark.dataSource.register(FlatGeobuf)
    own = dict(zip(("x0", "y0", "x1", "y1"), map(repr, map(float, box)), strict=True)) if box is not None else {}
    return spark.read.format("flatgeobuf").options(**own).load(path)


def hilbert(x: Column, y: Column, bits: int = HILBERT_BITS) -> Column:
    """The number of a cell (x, y) along the Hilbert curve of 2**bits by 2**bits cells, from its highest bit down."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, j: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        a, b = F.when(s["x"].bitwiseAND(size) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(size) > 0, 1).otherwise(0)
        d = s["d"] + size * size * (F.lit(3) * a).bitwiseXOR(b)
        whole = F.lit((1 << bits) - 1).cast("long")
        turned = lambda one, two: F.when(b == 1, s[one]).when(a == 1, whole - s[two]).otherwise(s[two])
        return F.struct(turned("x", "y").alias("x"), turned("y", "x").alias("y"), d.alias("d"))

    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.lit(bits - 1))), start, step)["d"]


def _properties(row: dict, columns: list[tuple[str, int, str]]) -> bytes:
    out = []
    for k, (name, _, code) in enumerate(columns):
        value = row[name]
        if value is not None:
            raw = struct.pack("<" + code, value) if code else struct.pack("<I", len(value.encode())) + value.encode()
            out.append(struct.pack("<H", k) + raw)
    return b"".join(out)


def write(features: DataFrame, path: str, name: str = "features", srs: int | None = None) -> str:
    """Features (kind, parts, and columns of their own) as one file. Geometries without points are left out."""
    spark = features.sparkSession
    spark.dataSource.register(FlatGeobuf)
    types = {f.name: f.dataType.simpleString() for f in features.schema if f.name not in ("kind", "parts")}
    columns = [(c, *COLUMNS[t]) for c, t in types.items()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                points = [p for part in row["parts"] or [] for ring in part for p in ring]
                if points:
                    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
                    rows.append((min(xs), min(ys), max(xs), max(ys), encoded(row["kind"], row["parts"], _properties(row, columns))))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.float64()] * 4 + [pa.binary()], strict=True)], ["x0", "y0", "x1", "y1", "data"])

    made = written(features.select("kind", "parts", *types).mapInArrow(encode, "x0 double, y0 double, x1 double, y1 double, data binary"), "features")
    whole = made.agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.count("*").alias("n")).first()
    n, most = whole["n"], (1 << HILBERT_BITS) - 1
    scaled = lambda a, b: F.floor(F.lit(most) * ((F.col(a) + F.col(b)) / 2 - whole[a]) / F.lit(whole[b] - whole[a])) if n and whole[b] > whole[a] else F.lit(0)
    keyed = made.withColumn("key", hilbert(scaled("x0", "x1"), scaled("y0", "y1")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.array([len(d.as_buffer()) for d in batch.column(4)], np.int64)
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.full(len(sizes), part, np.int64)), pa.array(np.arange(row, row + len(sizes))), pa.array(ends - sizes)], [*batch.schema.names[:5], "part", "row", "at"])
            row, at = row + len(sizes), int(ends[-1]) if len(sizes) else at

    order = ["key", "x0", "y0", "x1", "y1", "data"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("x0", "y0", "x1", "y1", "data")
    held = written(dealt.mapInArrow(placed, "x0 double, y0 double, x1 double, y1 double, data binary, part bigint, row bigint, at bigint"), "placed")
    # A row per part, as many as the cluster has partitions.
    sizes = held.groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.octet_length("data")).alias("bytes"))
    upto = lambda c: F.sum(c).over(Window.orderBy("part")) - F.col(c)
    before = sizes.select("part", upto("rows").alias("rows_before"), upto("bytes").alias("bytes_before"))
    leaf = written(held.join(F.broadcast(before), "part").select((F.col("rows_before") + F.col("row")).alias("j"), "x0", "y0", "x1", "y1", (F.col("bytes_before") + F.col("at")).alias("offset"), "data"), "leaves")
    rows = levels(n) if n else []
    index = NODE.size * sum(s for _, s in rows)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [node_bytes(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["at", "data"])

    now, out = leaf.drop("data"), leaf.select((F.col("offset") + index).alias("at"), "data")
    for level, (first, _) in enumerate(rows):
        if level:
            now = written(now.groupBy(F.floor(F.col("j") / FAN).alias("j")).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).withColumn("offset", F.col("j") * FAN + rows[level - 1][0]), "level")
        out = out.union(now.select(((F.col("j") + first) * NODE.size).alias("at"), "x0", "y0", "x1", "y1", "offset").mapInArrow(nodes, "at bigint, data binary"))
    kinds = [r["kind"] for r in features.select("kind").distinct().limit(2).collect()]
    head = [(0, "@s", name), (1, "@d", [whole[c] for c in ("x0", "y0", "x1", "y1")] if n else None), (2, "B", KINDS[kinds[0]] if len(kinds) == 1 else 0), (7, "@T", [[(0, "@s", c), (1, "B", t)] for c, t, _ in columns] or None), (8, "Q", n), (9, "H", FAN if n else 0), (10, "@t", [(1, "i", srs)] if srs is not None else None)]
    out.write.format("flatgeobuf").mode("append").option("head", (MAGIC + Buffer().finish(head)).hex()).save(path)
    return path
