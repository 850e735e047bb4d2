"""GeoTIFF of any size as a Spark source and sink.

Reading: the driver reads a file's head and no more of it than its tags; a partition is a rectangle of strips or tiles,
whose places and lengths the task looks up itself, and whose bytes it reads by ranges. A box of rows and columns leaves
what lies outside unread; it is given as options, or pushed down from filters on r and c, which ``read`` turns on for the
session. Strips that are neither packed nor predicted are read by rows, so a
file may well be one strip.

Writing: cells are brought together by tiles and packed in tasks; where a tile goes is the sum of what comes before it,
within its range of tiles and over the ranges; tasks put tiles and their places into one file under another name, and the
commit writes the head and gives the file its name. Nothing but the head passes through the driver. The file's folder has
to be one that driver and executors mount; what is read can be in any store that pyarrow opens.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from kelvora.operators.search import written
from kelvora.sources.geo import BITS, COMPRESSION, DEFLATE, FORMAT, HEIGHT, LZW, NODATA, NONE, OLD_DEFLATE, PREDICTOR, ROWS_PER_STRIP, SAMPLES, SCALE, STRIP_BYTES, STRIPS, TIE, TILE_BYTES, TILE_H, TILE_W, TILES, WIDTH, _block, _KINDS, _SIZES

#: Raw bytes of a partition, and of the rows that are read together of a strip that isn't packed.
PART_BYTES, ROWS_BYTES = 32 << 20, 1 << 20
_CELLS = "path string, i bigint, r bigint, c bigint, h double, m boolean"
Read = Callable[[int, int], bytes]


def ranges(path: str) -> tuple[Read, Callable[[], None]]:
    """(bytes at an offset, close) of a file in any store."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    file = store.open_input_file(inner)
    return (lambda at, n: file.read_at(n, at)), file.close


def listed(path: str) -> list[str]:
    return listed_as(path, (".tif", ".tiff"))


def listed_as(path: str, endings: tuple[str, ...]) -> list[str]:
    """A file, or the files of a folder with such endings."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return [head + x.path for x in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path) if x.path.lower().endswith(endings)]


class Head:
    """A file's tags. Long ones, such as the places of tiles, are read by slices."""

    def __init__(self, read: Read):
        self.read = read
        first = read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}[first[:2]]
        magic = struct.unpack_from(self.order + "H", first, 2)[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        at = struct.unpack_from(self.order + ("Q" if self.big else "I"), first, 8 if self.big else 4)[0]
        count, entry, inline, long_ = ("Q", 20, 8, "Q") if self.big else ("H", 12, 4, "I")
        n, size = struct.unpack(self.order + count, read(at, struct.calcsize(count)))[0], struct.calcsize(count)
        table = read(at + size, n * entry)
        self.tags: dict[int, tuple[int, int, int]] = {}
        for k in range(n):
            tag, kind, many = struct.unpack_from(self.order + "HH" + long_, table, k * entry)
            if kind in _SIZES:
                value = 4 + struct.calcsize(long_)
                held = _SIZES[kind][1] * many <= inline
                place = at + size + k * entry + value if held else struct.unpack_from(self.order + long_, table, k * entry + value)[0]
                self.tags[tag] = (kind, many, place)
        packed, predictor, bands = self.one(COMPRESSION, NONE), self.one(PREDICTOR, 1), self.one(SAMPLES, 1)
        kind = _KINDS.get((self.one(FORMAT, 1), self.one(BITS, 1)))
        if packed not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2, 3) or kind is None or bands != 1:
            raise ValueError(f"compression {packed}, predictor {predictor}, {bands} bands of {self.one(BITS, 1)} bits aren't read")
        self.packed, self.predictor, self.kind = packed, predictor, kind
        self.width, self.height, self.tiled = self.one(WIDTH), self.one(HEIGHT), TILES in self.tags
        strip = min(self.height, self.one(ROWS_PER_STRIP, self.height))
        self.tile_w, self.tile_h = (self.one(TILE_W), self.one(TILE_H)) if self.tiled else (self.width, strip)
        row = self.width * np.dtype(kind).itemsize
        #: Rows that are read together: part of a strip that is neither packed nor predicted, or a whole block.
        self.step = min(strip, max(1, ROWS_BYTES // row)) if not self.tiled and packed == NONE and predictor == 1 else self.tile_h
        self.across = -(-self.width // self.tile_w)
        text = bytes(self.values(NODATA)).rstrip(b"\0 ").decode() if NODATA in self.tags else ""
        self.nodata = float(text) if text else None

    def values(self, tag: int, a: int = 0, b: int | None = None) -> tuple | bytes:
        kind, many, place = self.tags[tag]
        code, size = _SIZES[kind]
        b = many if b is None else min(b, many)
        data = self.read(place + a * size, (b - a) * size)
        return data if kind == 2 else struct.unpack(f"{self.order}{(b - a) * len(code)}{code[0]}", data)

    def one(self, tag: int, default: int | None = None) -> int:
        return self.values(tag)[0] if tag in self.tags else default

    def place(self) -> dict[str, float]:
        tie, scale = (self.values(t) if t in self.tags else d for t, d in ((TIE, (0.0,) * 6), (SCALE, (1.0, 1.0, 0.0))))
        return {"origin_x": tie[3] - tie[0] * scale[0], "origin_y": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": scale[1]}

    def blocks(self, r0: int, r1: int, c0: int, c1: int) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(row, column, values) of the blocks, or the rows of strips, that meet rows r0 to r1 and columns c0 to c1, ends
        left out; None for a block that isn't there."""
        at, n = (TILES, TILE_BYTES) if self.tiled else (STRIPS, STRIP_BYTES)
        item = np.dtype(self.kind).itemsize
        for row in range(r0 // self.tile_h, -(-r1 // self.tile_h)):
            a, b = c0 // self.tile_w, -(-c1 // self.tile_w)
            first = row * self.across + a
            places, sizes = self.values(at, first, first + b - a), self.values(n, first, first + b - a)
            for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
                top, left = row * self.tile_h, (a + k) * self.tile_w
                high = min(self.tile_h, self.height - top) if not self.tiled else self.tile_h
                if not size:
                    yield top, left, None
                elif self.step == self.tile_h:
                    own = _block(self.read(place, size), self.packed, self.predictor, self.kind, self.order, high, self.tile_w)
                    yield top, left, own[: self.height - top, : self.width - left]
                else:
                    for r in range(max(top, r0 - (r0 - top) % self.step), min(top + high, r1), self.step):
                        rows = min(self.step, top + high - r)
                        raw = self.read(place + (r - top) * self.width * item, rows * self.width * item)
                        yield r, 0, np.frombuffer(raw, self.order + self.kind).reshape(-1, self.width)


@dataclass
class Box(InputPartition):
    path: str
    rows: tuple[int, int]
    cols: tuple[int, int]

    def __init__(self, path: str, rows: tuple[int, int], cols: tuple[int, int]):
        super().__init__((path, rows, cols))
        self.path, self.rows, self.cols = path, rows, cols


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.bytes = int(options.get("bytes", PART_BYTES))
        most = 1 << 62
        self.rows = int(options.get("r0", 0)), int(options.get("r1", most))
        self.cols = int(options.get("c0", 0)), int(options.get("c1", most))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of r and c. Blocks are cut to them, so Spark need not test them again."""
        for f in filters:
            name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if name not in (("r",), ("c",)) or not isinstance(value, int) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            low = value + 1 if isinstance(f, GreaterThan) else value if isinstance(f, EqualTo | GreaterThanOrEqual) else 0
            high = value if isinstance(f, LessThan) else value + 1 if isinstance(f, EqualTo | LessThanOrEqual) else 1 << 62
            side = "rows" if name == ("r",) else "cols"
            a, b = getattr(self, side)
            setattr(self, side, (max(a, low), min(b, high)))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in (p for given in self.paths for p in listed(given)):
            read, close = ranges(path)
            head = Head(read)
            close()
            r0, r1, c0, c1 = max(0, self.rows[0]), min(head.height, self.rows[1]), max(0, self.cols[0]), min(head.width, self.cols[1])
            if r0 >= r1 or c0 >= c1:
                continue
            # Rectangles of whole blocks: as many columns of them as fit, and then as many rows.
            size, th = head.tile_w * head.step * np.dtype(head.kind).itemsize, head.step if head.step < head.tile_h else head.tile_h
            wide = min(-(-c1 // head.tile_w) - c0 // head.tile_w, max(1, self.bytes // size))
            tall = max(1, self.bytes // (size * wide))
            for r in range(r0 // th, -(-r1 // th), tall):
                for c in range(c0 // head.tile_w, -(-c1 // head.tile_w), wide):
                    out.append(Box(path, (max(r0, r * th), min(r1, (r + tall) * th)), (max(c0, c * head.tile_w), min(c1, (c + wide) * head.tile_w))))
        return out

    def read(self, partition: Box | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file meets the box
            return
        read, close = ranges(partition.path)
        head, (r0, r1), (c0, c1) = Head(read), partition.rows, partition.cols
        for top, left, values in head.blocks(r0, r1, c0, c1):
            if values is None:  # no tile is all nodata
                values = np.full((min(head.tile_h, head.height - top), min(head.tile_w, head.width - left)), np.nan)
            own = values[max(0, r0 - top) : r1 - top, max(0, c0 - left) : c1 - left].astype(np.float64)
            h, w = own.shape
            r, c = np.repeat(np.arange(h) + max(top, r0), w), np.tile(np.arange(w) + max(left, c0), h)
            flat = own.ravel()
            good = np.isfinite(flat) & (flat != head.nodata if head.nodata is not None else True)
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(flat)), pa.array(r * head.width + c), pa.array(r), pa.array(c), pa.array(flat), pa.array(good)], ["path", "i", "r", "c", "h", "m"])
        close()


@dataclass
class Layout:
    """Where everything is in a file that is written: the head, then places and lengths of all tiles, then tiles."""

    rows: int
    cols: int
    tile: int
    kind: str
    origin_x: float
    origin_y: float
    dx: float
    dy: float
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.cols // self.tile)

    @property
    def tiles(self) -> int:
        return self.across * -(-self.rows // self.tile)

    @property
    def places(self) -> int:
        return 1024

    @property
    def sizes(self) -> int:
        return self.places + 8 * self.tiles

    @property
    def data(self) -> int:
        return self.places + 16 * self.tiles

    def head(self) -> bytes:
        """A big file's head, of a fixed number of bytes."""
        form, bits = {"f4": (3, 32), "f8": (3, 64)}[self.kind]
        extra, entries = b"", []
        text = b"" if self.nodata is None else f"{self.nodata:g}\0".encode()
        whole = [(WIDTH, 4, "I", self.cols), (HEIGHT, 4, "I", self.rows), (BITS, 3, "H", bits), (COMPRESSION, 3, "H", DEFLATE), (262, 3, "H", 1), (SAMPLES, 3, "H", 1), (TILE_W, 4, "I", self.tile), (TILE_H, 4, "I", self.tile), (FORMAT, 3, "H", form)]
        for tag, kind, code, value in whole:
            entries.append((tag, kind, 1, struct.pack("<" + code, value)))
        for tag, at in ((TILES, self.places), (TILE_BYTES, self.sizes)):
            # A single number stands in its entry, which a task can't know of: it is read from where tasks write it.
            entries.append((tag, 16, self.tiles, struct.pack("<Q", at)))
        base = 16 + 8 + 20 * (len(entries) + 2 + bool(text)) + 8
        for tag, values in ((SCALE, (self.dx, self.dy, 0.0)), (TIE, (0.0, 0.0, 0.0, self.origin_x, self.origin_y, 0.0))):
            entries.append((tag, 12, len(values), struct.pack("<Q", base + len(extra))))
            extra += struct.pack(f"<{len(values)}d", *values)
        if text:
            entries.append((NODATA, 2, len(text), text if len(text) <= 8 else struct.pack("<Q", base + len(extra))))
            extra += text if len(text) > 8 else b""
        body = b"".join(struct.pack("<HHQ", tag, kind, n) + value.ljust(8, b"\0") for tag, kind, n, value in sorted(entries))
        return (struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + body + struct.pack("<Q", 0) + extra).ljust(self.places, b"\0")


@dataclass
class Written(WriterCommitMessage):
    tiles: int


class GeoTiffWriter(DataSourceArrowWriter):
    """Puts rows (tile, at, data) into one file. Writing a tile twice writes the same bytes to the same place."""

    def __init__(self, options: dict):
        self.path, self.layout = options["path"].removeprefix("file://").removeprefix("file:"), Layout(**{k: _READ[k](options[k]) for k in _READ})
        self.work = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, n = self.layout, 0
        file = os.open(self.work, os.O_CREAT | os.O_WRONLY, 0o644)
        for batch in iterator:
            for tile, at, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("tile", "at", "data")), strict=True):
                tile, at, data = tile.as_py(), at.as_py(), data.as_py()
                os.pwrite(file, data, own.data + at)
                os.pwrite(file, struct.pack("<Q", own.data + at), own.places + 8 * tile)
                os.pwrite(file, struct.pack("<Q", len(data)), own.sizes + 8 * tile)
                n += 1
        os.fsync(file)
        os.close(file)
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        own, head = self.layout, bytearray(self.layout.head())
        file = os.open(self.work, os.O_CREAT | os.O_RDWR, 0o644)
        os.truncate(self.work, max(os.fstat(file).st_size, own.data))
        if own.tiles == 1:  # a single place and length stand in the head itself
            for tag, at in ((TILES, own.places), (TILE_BYTES, own.sizes)):
                k = next(k for k in range(struct.unpack_from("<Q", head, 16)[0]) if struct.unpack_from("<H", head, 24 + 20 * k)[0] == tag)
                head[24 + 20 * k + 12 : 24 + 20 * k + 20] = os.pread(file, 8, at)
        os.pwrite(file, bytes(head), 0)
        os.fsync(file)
        os.close(file)
        os.replace(self.work, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.work):
            os.remove(self.work)


_READ = {"rows": int, "cols": int, "tile": int, "kind": str, "origin_x": float, "origin_y": float, "dx": float, "dy": float, "nodata": lambda x: None if x == "" else float(x)}


class GeoTiff(DataSource):
    """Options to read: path (a file, a folder, or several with commas), r0, r1, c0, c1, bytes. To write, see ``write``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return _CELLS

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options))


def read(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, i, r, c, h, m): a row per cell, of rows and columns from the first up to the second where they are given."""
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    box = {k: v for pair, names in ((rows, ("r0", "r1")), (cols, ("c0", "c1"))) if pair is not None for k, v in zip(names, pair, strict=True)}
    return spark.read.format("geotiff").options(bytes=part_bytes, **box).load(path)


def packed(cells: DataFrame, value: str, layout: Layout) -> DataFrame:
    """(part, tile, at, data): tiles that have a cell, packed, and where they come within their part; cells are (r, c, value).
    A cell that is there twice has one of its values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tile, values, at = TaskContext.get().partitionId(), None, None, 0
        fill = np.nan if layout.nodata is None else layout.nodata

        def done() -> pa.RecordBatch:
            nonlocal at
            data = zlib.compress(values.tobytes(), 6)
            at += len(data)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([tile], pa.int64()), pa.array([at - len(data)], pa.int64()), pa.array([data], pa.binary())], ["part", "tile", "at", "data"])

        for batch in batches:
            tiles, r, c, v = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for own in np.split(np.arange(len(tiles)), np.flatnonzero(np.diff(tiles)) + 1):
                if not len(own):
                    continue
                if tiles[own[0]] != tile:
                    if tile is not None:
                        yield done()
                    tile, values = int(tiles[own[0]]), np.full((layout.tile, layout.tile), fill, "<" + layout.kind)
                values[r[own] % layout.tile, c[own] % layout.tile] = np.where(np.isnan(v[own]), fill, v[own])
        if tile is not None:
            yield done()

    tile = F.floor(F.col("r") / layout.tile) * layout.across + F.floor(F.col("c") / layout.tile)
    inside = (F.col("r") >= 0) & (F.col("r") < layout.rows) & (F.col("c") >= 0) & (F.col("c") < layout.cols) & F.col(value).isNotNull()
    own = cells.where(inside).select(tile.alias("tile"), F.col("r").cast("long"), F.col("c").cast("long"), F.col(value).cast("double"))
    return own.repartitionByRange("tile").sortWithinPartitions("tile").mapInArrow(pack, "part bigint, tile bigint, at bigint, data binary")


def write(cells: DataFrame, path: str, rows: int, cols: int, value: str = "h", origin_x: float = 0.0, origin_y: float = 0.0, dx: float = 1.0, dy: float = 1.0, nodata: float | None = None, tile: int = 256, kind: str = "f4") -> str:
    """A field (r, c, value) of any size as one tiled, deflated file; cells that aren't there, are null or NaN hold nodata."""
    spark, layout = cells.sparkSession, Layout(rows, cols, tile, kind, origin_x, origin_y, dx, dy, nodata)
    spark.dataSource.register(GeoTiff)
    held = written(packed(cells, value, layout), "tiles")
    # A row per part, as many as the cluster has partitions.
    sizes = held.groupBy("part").agg(F.sum(F.octet_length("data")).alias("size"), F.min("tile").alias("first"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("first")) - F.col("size")).alias("before"))
    placed = held.join(F.broadcast(before), "part").select("tile", (F.col("at") + F.col("before")).alias("at"), "data")
    options = {k: "" if getattr(layout, k) is None else str(getattr(layout, k)) for k in _READ}
    placed.write.format("geotiff").mode("append").options(**options).save(path)
    return path
