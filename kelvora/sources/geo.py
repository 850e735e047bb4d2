"""Files of points, rasters and tags."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {(1, 8): "u1", (2, 8): "i1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
#: TIFF tags: fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIE, NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first, wider one entry early; 256 clears, 257 ends."""
    out, table, width, held, have, last = [], [], 9, 0, 0, None
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        own = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + own[:1])
        out.append(own)
        last = own
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _ifd(data: bytes) -> tuple[str, dict]:
    """(byte order, tags) of the first image, of classic or big files."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count, entry, inline, long_ = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    n, first, tags = struct.unpack_from(order + count, data, at)[0], at + struct.calcsize(count), {}
    for k in range(n):
        here = first + entry * k
        tag, kind, many = struct.unpack_from(order + "HH" + long_, data, here)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        value = here + 4 + struct.calcsize(long_)
        place = value if size * many <= inline else struct.unpack_from(order + long_, data, value)[0]
        tags[tag] = data[place : place + many] if kind == 2 else struct.unpack_from(f"{order}{many * len(code)}{code[0]}", data, place)
    return order, tags


def _block(raw: bytes, packed: int, predictor: int, kind: str, order: str, h: int, w: int) -> np.ndarray:
    import zlib

    raw = raw if packed == NONE else _unlzw(raw) if packed == LZW else zlib.decompress(raw)
    size = np.dtype(kind).itemsize
    h = min(h, len(raw) // (w * size))
    if predictor == 3:  # bytes of a row, highest first plane by plane, each less the one before
        rows = np.cumsum(np.frombuffer(raw, np.uint8)[: h * w * size].reshape(h, w * size), axis=1, dtype=np.uint8)
        return rows.reshape(h, size, w).transpose(0, 2, 1).copy().view(">" + kind).reshape(h, w)
    values = np.frombuffer(raw, order + kind)[: h * w].reshape(h, w)
    if predictor == 2:
        whole = f"u{size}"
        values = np.cumsum(values.astype(kind).view(whole), axis=1, dtype=whole).view(kind)
    return values


def decode_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """(values, {origin_x, origin_y, dx, dy, nodata}) of a single-band TIFF in strips or tiles: plain, deflated or LZW, with
    either predictor or none. What else a file may hold raises."""
    order, tags = _ifd(data)
    w, h, packed, predictor = tags[WIDTH][0], tags[HEIGHT][0], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    kind = _KINDS.get((tags.get(FORMAT, (1,))[0], tags[BITS][0]))
    if packed not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2, 3) or kind is None or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError(f"compression {packed}, predictor {predictor}, {tags.get(SAMPLES, (1,))[0]} bands of {tags[BITS]} bits aren't read")
    out = np.zeros((h, w), kind)
    if TILES in tags:
        tw, th, at, n = tags[TILE_W][0], tags[TILE_H][0], tags[TILES], tags[TILE_BYTES]
    else:
        tw, th, at, n = w, tags.get(ROWS_PER_STRIP, (h,))[0], tags[STRIPS], tags[STRIP_BYTES]
    across = -(-w // tw)
    for k, (a, size) in enumerate(zip(at, n, strict=True)):
        r, c = k // across * th, k % across * tw
        if not size:  # a tile that isn't there
            out[r : r + th, c : c + tw] = float(tags[NODATA].rstrip(b"\0 ").decode()) if NODATA in tags else 0
            continue
        own = _block(data[a : a + size], packed, predictor, kind, order, th if TILES in tags else min(th, h - r), tw)[: h - r, : w - c]
        out[r : r + own.shape[0], c : c + own.shape[1]] = own
    tie, scale = tags.get(TIE, (0.0,) * 6), tags.get(SCALE, (1.0, 1.0, 0.0))
    nodata = float(tags[NODATA].rstrip(b"\0 ").decode()) if NODATA in tags else None
    return out, {"origin_x": tie[3] - tie[0] * scale[0], "origin_y": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": scale[1], "nodata": nodata}


def encode_tiff(values: np.ndarray, origin_x: float, origin_y: float, dx: float, dy: float, nodata: float | None = None) -> bytes:
    """One strip, uncompressed, of float32, float64 or uint8."""
    values = np.ascontiguousarray(values)
    form, bits = {"f4": (3, 32), "f8": (3, 64), "u1": (1, 8)}[values.dtype.str[1:]]
    h, w = values.shape
    entries: list[tuple[int, int, int, bytes]] = []
    add = lambda tag, kind, code, *v: entries.append((tag, kind, len(v), struct.pack(f"<{len(v)}{code}", *v)))
    add(WIDTH, 4, "I", w)
    add(HEIGHT, 4, "I", h)
    add(BITS, 3, "H", bits)
    add(COMPRESSION, 3, "H", 1)
    add(262, 3, "H", 1)
    add(STRIPS, 4, "I", 0)
    add(277, 3, "H", 1)
    add(ROWS_PER_STRIP, 4, "I", h)
    add(STRIP_BYTES, 4, "I", values.nbytes)
    add(FORMAT, 3, "H", form)
    add(SCALE, 12, "d", dx, dy, 0.0)
    add(TIE, 12, "d", 0.0, 0.0, 0.0, origin_x, origin_y, 0.0)
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        entries.append((NODATA, 2, len(text), text))
    base = 8 + 2 + 12 * len(entries) + 4
    extra, body = b"", b""
    size = sum(len(v) + len(v) % 2 for *_, v in entries if len(v) > 4)
    for tag, kind, n, v in entries:
        if tag == STRIPS:
            v = struct.pack("<I", base + size)
        if len(v) > 4:
            body += struct.pack("<HHII", tag, kind, n, base + len(extra))
            extra += v + b"\0" * (len(v) % 2)
        else:
            body += struct.pack("<HHI", tag, kind, n) + v.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + b"\0" * 4 + extra + values.astype(values.dtype.newbyteorder("<")).tobytes()


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, r, c, h, m): a row per cell; files are decoded where they are read, rows are sent on in bands."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                values, head = decode_tiff(data)
                h, w = values.shape
                band = max(1, 200_000 // w)
                for r in range(0, h, band):
                    own = values[r : r + band].astype(np.float32).ravel()
                    i = np.arange(len(own)) + r * w
                    good = np.isfinite(own) & (own != np.float32(head["nodata"]) if head["nodata"] is not None else True)
                    yield pd.DataFrame({"path": name, "i": i, "r": (i // w).astype(np.int32), "c": (i % w).astype(np.int32), "h": own, "m": good})

    return files.mapInPandas(cells, "path string, i bigint, r int, c int, h float, m boolean")


def metric(origin_x: float, origin_y: float, dx: float, dy: float, rows: int) -> tuple[float, float]:
    """Cell sizes in metres; degrees are told by small origins and small steps."""
    import math

    if abs(origin_x) < 360 and abs(origin_y) < 90 and dx < 0.01:
        return dx * 111320 * math.cos(math.radians(origin_y - rows * dy / 2)), dy * 110574
    return dx, dy


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, kind, coordinates as JSON, properties as JSON) of FeatureCollections."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x"))
    return whole.select(F.posexplode("x.features").alias("feature", "f")).select("feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Files with a header, written by tasks; a cell with a comma, a quote or a line's end is quoted, a null is empty."""
    rows.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_geojson(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(value): a feature a row, for newline-delimited files."""
    rest = [c for c in points.columns if c not in (x, y)]
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def read_census_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated Latin-1 with text codes."""
    return spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).option("inferSchema", False).csv(path)


def hstore(tags: Column, key: str) -> Column:
    """The value of a key in '"k"=>"v"' text, null if it isn't there."""
    found = F.regexp_extract(tags, f'"{key}"=>"([^"]*)"', 1)
    return F.when(tags.contains(f'"{key}"=>"'), found)


def wkt_points(wkt: Column) -> Column:
    """The points of the first ring or line of a WKT text, null with fewer than two."""
    inner = F.regexp_extract(wkt, r"\(([^()]*)\)", 1)
    pairs = F.filter(F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.size(p) >= 2)
    points = F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    return F.when(F.size(points) >= 2, points)


def write_bundle(fields: dict[str, DataFrame], meta: dict, folder: str) -> None:
    """Parquet per field beside a JSON document that names them."""
    for name, df in fields.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    first = next(iter(fields.values()))
    text = json.dumps({"@type": "EnergyFieldBundle", "schemaVersion": 3, "fields": sorted(fields)} | meta)
    first.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_bundle")


def frame_message(head: dict, *arrays: np.ndarray) -> bytes:
    """A length-prefixed JSON head and raw little-endian arrays after it."""
    text = json.dumps(head | {"arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    return struct.pack("<I", len(text)) + text + b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays)


def read_message(data: bytes) -> tuple[dict, list[np.ndarray]]:
    """Raises unless the message has exactly the length that its head tells."""
    (n,) = struct.unpack_from("<I", data)
    head, at, out = json.loads(data[4 : 4 + n]), 4 + n, []
    for kind, count in head.pop("arrays"):
        size = np.dtype(kind).itemsize * count
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    if at != len(data):
        raise ValueError("a message of another length")
    return head, out


def raster_grid(cells: DataFrame, path: str, rows: int, cols: int, value: str, **geo: float) -> str:
    """A field (i, value) as one GeoTIFF, written by tasks."""
    from kelvora.sources import tiff

    own = cells.select(F.floor(F.col("i") / cols).alias("r"), F.pmod("i", F.lit(cols)).alias("c"), value)
    return tiff.write(own, path, rows, cols, value, **geo)
