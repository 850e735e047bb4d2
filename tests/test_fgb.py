"""FlatGeobuf: boxes against full scans, bytes that are read, and the layout of what is written."""

from __future__ import annotations

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from kelvora.sources import fgb

SCHEMA = "kind string, parts array<array<array<struct<x:double,y:double>>>>, num bigint, name string, share double, fine boolean, small int"


def _features(n, rng):
    out = []
    for k in range(n):
        x, y = rng.uniform(-50, 50), rng.uniform(-20, 20)
        ring = lambda m: [(x + rng.uniform(0, 2), y + rng.uniform(0, 2)) for _ in range(m)]
        kind = rng.choice(list(fgb.KINDS))
        parts = {"Point": lambda: [[ring(1)]], "LineString": lambda: [[ring(rng.randint(2, 6))]], "Polygon": lambda: [[ring(4) for _ in range(rng.randint(1, 3))]], "MultiPoint": lambda: [[ring(1)] for _ in range(3)], "MultiLineString": lambda: [[ring(rng.randint(2, 4))] for _ in range(rng.randint(1, 3))], "MultiPolygon": lambda: [[ring(4) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 3))]}[kind]()
        out.append((kind, parts, k, rng.choice(("Rua é", "", None, "x" * 40)), rng.choice((None, 0.5)), rng.choice((True, False, None)), rng.choice((None, 7))))
    return out


def _box(parts):
    xs, ys = zip(*(p for part in parts for ring in part for p in ring), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 700])
def test_boxes_equal_scans(spark, tmp_path, n, monkeypatch):
    rng = random.Random(n)
    rows = _features(n, rng)
    df = spark.createDataFrame([*rows, ("Point", [], -1, None, None, None, None)], SCHEMA).repartition(5)
    path = fgb.write(df, str(tmp_path / "a.fgb"))
    assert os.listdir(tmp_path) == ["a.fgb"]
    for box in (None, (-10, -5, 10, 5), (3, 3, 3.5, 3.5), (90, 90, 99, 99)):
        want = {}
        for kind, parts, k, name, share, fine, small in rows:
            a, b, c, d = _box(parts)
            if box is None or a <= box[2] and c >= box[0] and b <= box[3] and d >= box[1]:
                want[k] = (kind, parts, {x: v for x, v in (("num", k), ("name", name), ("share", share), ("fine", fine), ("small", small)) if v is not None})
        got = fgb.read(spark, path, box).collect()
        assert sorted(r.id for r in got) == sorted({r.id for r in got}) and len(got) == len(want)
        for r in got:
            told = json.loads(r.properties)
            assert (r.kind, [[[(p.x, p.y) for p in ring] for ring in part] for part in r.parts], told) == want[told["num"]]


def test_a_box_reads_its_nodes_only(spark, tmp_path, monkeypatch):
    points = spark.range(40_000).select(F.lit("Point").alias("kind"), F.array(F.array(F.array(F.struct((F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y"))))).alias("parts"), F.col("id").alias("num"))
    path = fgb.write(points, str(tmp_path / "p.fgb"))
    read, plain = [], fgb.ranges

    def counted(p):
        own, close = plain(p)
        return (lambda at, n: (read.append(n), own(at, n))[1]), close

    monkeypatch.setattr(fgb, "ranges", counted)
    reader = fgb.FgbReader({"path": path, "x0": "50", "y0": "50", "x1": "54", "y1": "53"})
    got = sorted(json.loads(p)["num"] for part in reader.partitions() for b in reader.read(part) for p in b.column(3).to_pylist())
    assert got == sorted(x + 200 * y for x in range(50, 55) for y in range(50, 54))
    assert sum(read) < os.path.getsize(path) / 50
    assert len(fgb.FgbReader({"path": path}).partitions()) <= fgb.DEALT  # and all of them are dealt out by nodes


def test_layout(spark, tmp_path):
    """The file's parts by the format's rules: levels from the root, leaves last, sixteen children, features end to end."""
    rng = random.Random(3)
    path = fgb.write(spark.createDataFrame(_features(300, rng), SCHEMA), str(tmp_path / "l.fgb"), name="l", srs=4326)
    data = open(path, "rb").read()
    assert data[:8] == b"fgb\x03fgb\x01"
    (size,) = struct.unpack_from("<I", data, 8)
    head = fgb.Table.root(data[12 : 12 + size])
    assert head.raw(0) == b"l" and head.scalar(8, "Q", 0) == 300 and head.scalar(9, "H", 0) == 16 and head.table(10).scalar(1, "i", 0) == 4326
    assert fgb.levels(300) == [(22, 300), (3, 19), (1, 2), (0, 1)] and fgb.levels(1) == [(1, 1), (0, 1)]
    nodes = [fgb.NODE.unpack_from(data, 12 + size + 40 * k) for k in range(sum(s for _, s in fgb.levels(300)))]
    for level, (first, n) in enumerate(fgb.levels(300)[1:], 1):
        low, count = fgb.levels(300)[level - 1]
        for j in range(n):
            own = nodes[low + 16 * j : low + min(16 * (j + 1), count)]
            assert nodes[first + j] == (min(x[0] for x in own), min(x[1] for x in own), max(x[2] for x in own), max(x[3] for x in own), low + 16 * j)
    at, first = 12 + size + 40 * len(nodes), fgb.levels(300)[0][0]
    for k in range(300):
        assert nodes[first + k][4] == at - (12 + size + 40 * len(nodes))
        at += 4 + struct.unpack_from("<I", data, at)[0]
    assert at == len(data)


def test_hilbert_numbers(spark):
    """Every cell has its own number, and cells that follow one another are neighbours."""
    df = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    got = sorted((r.d, r.x, r.y) for r in df.select("x", "y", fgb.hilbert(F.col("x"), F.col("y"), 6).alias("d")).collect())
    assert [g[0] for g in got] == list(range(4096))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:], strict=False))
