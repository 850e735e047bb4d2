"""GeoTIFF as a source and a sink: against whole decoding, by the bytes that are read, and by round trips."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvora.sources import geo, tiff
from test_more import tiff as made


def _rows(values, nodata=None):
    return {(r, c): float(x) if np.isfinite(x) else None for (r, c), x in np.ndenumerate(values)}


@pytest.mark.parametrize(("packed", "predictor", "tile", "big", "order"), [(1, 1, None, False, "<"), (1, 1, None, True, ">"), (8, 2, 16, False, "<"), (5, 1, None, False, ">"), (8, 3, 16, True, "<")])
def test_read_of_boxes(spark, tmp_path, packed, predictor, tile, big, order, monkeypatch):
    rng = np.random.default_rng(1)
    values = (rng.random((70, 45)) * 100).astype("f4") if predictor != 2 else rng.integers(0, 1000, (70, 45)).astype("i4")
    path = tmp_path / "a.tif"
    path.write_bytes(made(values, packed, predictor, tile, big, order))
    for rows, cols in ((None, None), ((0, 1), None), ((13, 50), (7, 33)), ((69, 999), (44, 99)), ((80, 90), None)):
        got = tiff.read(spark, str(path), rows, cols, part_bytes=2000).collect()
        a, b = (rows or (0, 70)), (cols or (0, 45))
        want = {(r, c): float(values[r, c]) for r in range(*a) if r < 70 for c in range(*b) if c < 45}
        assert {(x.r, x.c): x.h for x in got} == want and len(got) == len(want) and all(x.m and x.i == x.r * 45 + x.c for x in got)


def test_filters_are_pushed(spark, tmp_path):
    values = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    (tmp_path / "b.tif").write_bytes(made(values, 8, 1, 16, False, "<"))
    (tmp_path / "a.tif").write_bytes(made(values[:5], 8, 1, 16, False, "<"))
    (tmp_path / "no.txt").write_bytes(b"no")
    assert tiff.read(spark, str(tmp_path)).count() == 64 * 64 + 5 * 64
    own = tiff.read(spark, f"{tmp_path}/b.tif").where("r >= 10 and r < 20 and c = 33 and h > 700")
    assert sorted(x.h for x in own.collect()) == [float(values[r, 33]) for r in range(10, 20) if values[r, 33] > 700]
    reader = tiff.GeoTiffReader({"path": str(tmp_path / "b.tif")})
    left = list(reader.pushFilters([tiff.GreaterThan(("r",), 9), tiff.LessThanOrEqual(("c",), 20), tiff.EqualTo(("h",), 3)]))
    assert [f.attribute for f in left] == [("h",)] and reader.rows == (10, 1 << 62) and reader.cols == (0, 21)


def test_a_box_reads_its_bytes_only(tmp_path, monkeypatch):
    """Of a file of 12 GB, one strip that isn't packed, and of one in tiles."""
    path = tmp_path / "large.tif"
    rows, cols = 60_000, 50_000
    entries = [(256, 4, cols), (257, 4, rows), (258, 3, 32), (259, 3, 1), (273, 16, 4096), (277, 3, 1), (278, 4, rows), (279, 16, rows * cols * 4), (339, 3, 3)]
    body = b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in entries)
    with path.open("wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + body + bytes(8))
        f.seek(4096 + (40_000 * cols + 123) * 4)
        f.write(struct.pack("<f", 7.5))
        f.truncate(4096 + rows * cols * 4)
    read, plain = [], tiff.ranges

    def counted(p):
        own, close = plain(p)

        def take(at, n):
            read.append(n)
            return own(at, n)

        return take, close

    monkeypatch.setattr(tiff, "ranges", counted)
    reader = tiff.GeoTiffReader({"path": str(path), "r0": "40000", "r1": "40003", "c0": "100", "c1": "200"})
    parts = reader.partitions()
    assert sum(read) < 2000 and len(parts) == 1
    cells = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in cells) == 300 and max(max(b.column(4).to_pylist()) for b in cells) == 7.5
    assert sum(read) < 6_000_000 and max(read) <= max(tiff.ROWS_BYTES, cols * 4)
    assert len(tiff.GeoTiffReader({"path": str(path)}).partitions()) > 300  # and no part has more than PART_BYTES
    values = np.random.default_rng(3).random((512, 512)).astype("f4")
    tiled = tmp_path / "tiled.tif"
    tiled.write_bytes(made(values, 8, 1, 64, False, "<"))
    read.clear()
    reader = tiff.GeoTiffReader({"path": str(tiled), "r0": "70", "r1": "120", "c0": "130", "c1": "190"})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == 50 * 60 and sum(read) < os.path.getsize(tiled) / 30


@pytest.mark.parametrize(("rows", "cols", "tile", "nodata", "kind"), [(70, 45, 16, -9999.0, "f4"), (5, 5, 16, None, "f8"), (16, 300, 16, -1.0, "f4"), (40, 40, 256, -9999.0, "f4")])
def test_written_by_tasks(spark, tmp_path, rows, cols, tile, nodata, kind):
    rng = random.Random(rows)
    cells = [(r, c, float(np.float32(rng.random() * 50)) if rng.random() > 0.1 else None) for r in range(rows) for c in range(cols) if rng.random() > 0.2 and (r // 16 + c // 16) % 4 != 1]
    df = spark.createDataFrame(cells, "r long, c long, h double").repartition(7)
    path = str(tmp_path / "out.tif")
    for again in range(2):  # a file that is there is replaced
        tiff.write(df.where("r >= 0") if again else df.limit(3), path, rows, cols, origin_x=-46.5, origin_y=-23.25, dx=0.5, dy=0.25, nodata=nodata, tile=tile, kind=kind)
    values, head = geo.decode_tiff(open(path, "rb").read())
    assert values.shape == (rows, cols) and (head["origin_x"], head["origin_y"], head["dx"], head["dy"], head["nodata"]) == (-46.5, -23.25, 0.5, 0.25, nodata)
    want = {(r, c): h for r, c, h in cells if h is not None}
    # A tile that isn't there is nodata, or 0 where the file names none.
    assert all(values[r, c] == h for (r, c), h in want.items())
    back = {(x.r, x.c): x.h for x in tiff.read(spark, path).where("m").collect()}
    assert back == want and os.listdir(tmp_path) == ["out.tif"]


def test_a_field_without_cells(spark, tmp_path):
    path = tiff.write(spark.createDataFrame([], "r long, c long, h double"), str(tmp_path / "none.tif"), 40, 40, nodata=-9999.0, tile=16)
    assert tiff.read(spark, path).where("m").count() == 0 and tiff.read(spark, path).count() == 1600
    assert (geo.decode_tiff(open(path, "rb").read())[0] == -9999).all()
