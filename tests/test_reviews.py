"""Reach matching, errors of a correction, and reviews, against plain versions."""

from __future__ import annotations

import csv
import random
from pathlib import Path

import pytest
from kelvora.operators import order, profile, sampling
from kelvora.sources import geo


def _q(v, p):
    return v[min(len(v) - 1, int(p * len(v)))]


def test_reach_matching(spark):
    rng = random.Random(4)
    ref = [(k, rng.choice([rng.uniform(0, 9), 3.0])) for k, n in ((1, 300), (2, 40), (3, 1)) for _ in range(n)]
    own = [(k, e * rng.uniform(1.0, 1.3)) for k, e in ref] + [(4, 1.0), (4, 2.0), (5, 0.0), (6, None)]
    far = [*ref, (4, 50.0), (5, 0.0), (7, 1.0), (1, None)]
    got = {(r.k, r.share): r for r in profile.reach_match(spark.createDataFrame(own, "k long, e double"), spark.createDataFrame(far, "k long, e double"), "k").collect()}
    assert {k for k, _ in got} == {1, 2, 3, 4, 5}
    for (k, share), r in got.items():
        mine, theirs = sorted(e for j, e in own if j == k), sorted(e for j, e in far if j == k and e is not None)
        budget = _q(mine, share)
        target = sum(e <= budget for e in theirs)
        assert (r.budget, r.target) == (budget, target)
        want = mine[min(len(mine) - 1, target - 1)] / budget if target and budget else None
        assert r.inflation == (want if want is None else pytest.approx(want))
    assert got[4, 0.5].inflation is None and got[5, 0.5].inflation is None


def test_places_of_a_group(spark):
    rows = spark.createDataFrame([("a", float(x % 7)) for x in range(50)] + [("b", 1.0)], "g string, v double")
    asked = spark.createDataFrame([("a", "first", 0), ("a", "last", 999), ("a", "mid", 25), ("b", "none", -1), ("c", "no", 0)], "g string, name string, at long")
    own = sorted(float(x % 7) for x in range(50))
    assert {tuple(r) for r in order.at_places(rows, "g", "v", asked).collect()} == {("a", "first", own[0]), ("a", "last", own[-1]), ("a", "mid", own[25])}


def test_errors_of_a_correction(spark):
    rng = random.Random(5)
    rows = [(k, x, x * (1.02 + 0.01 * k + 0.002 * x / d + rng.uniform(0, 0.01)), d) for k in range(3) for x, d in ((rng.uniform(1, 50), rng.uniform(1, 9)) for _ in range(60 + k))]
    got = {r.kind: r for r in profile.correction_errors(spark.createDataFrame([*rows, (1, 0.0, 1.0, 1.0), (1, 1.0, None, 1.0)], "k long, x double, y double, d double"), "k").collect()}
    ratio, hill = [y / x for _, x, y, _ in rows], [x / d for _, x, _, d in rows]
    c = sum(_q(sorted(y / x for j, x, y, _ in rows if j == k), 0.5) for k in range(3)) / 3
    mx, my = sum(hill) / len(rows), sum(ratio) / len(rows)
    b = sum((h - mx) * (r - my) for h, r in zip(hill, ratio, strict=True)) / sum((h - mx) ** 2 for h in hill)
    for kind, told in (("raw", [1.0] * len(rows)), ("shared", [c] * len(rows)), ("fitted", [my + b * (h - mx) for h in hill])):
        errors = sorted(abs(r / t - 1) for r, t in zip(ratio, told, strict=True))
        r = got[kind]
        assert r.n == len(rows) and [r.p50, r.p90, r.p99, r.worst] == pytest.approx([_q(errors, 0.5), _q(errors, 0.9), _q(errors, 0.99), errors[-1]])
        assert r.under == pytest.approx(sum(x < t for x, t in zip(ratio, told, strict=True)) / len(rows))
    assert got["fitted"].p90 < got["shared"].p90 < got["raw"].p90


def test_reviews_and_their_export(spark, tmp_path):
    pick = "picks array<struct<d: double, alt: double>>"
    rows = [(1, [(1.0, 10.0), (2.0, 16.0)], 5.0, 1, 'Ponte "A", sul', "primary", 1.5, 2.5), (2, [(1.0, 10.0), (2.0, 15.0)], None, 0, None, None, 3.0, 4.0), (3, [(1.0, 10.0)], 8.0, None, "C", None, 5.0, 6.0)]
    scored = sampling.review_score(spark.createDataFrame(rows, f"id long, {pick}, terr double, layer int, name string, highway string, x double, y double"))
    said = spark.createDataFrame(
        [(1, "rejected", 1.0, None, 1.0, None, 1), (1, "approved", 12.34, "manual", 7.0, "two\nlines", 2), (2, "approved", 9.96, None, 3.0, None, 1), (9, "approved", 1.0, None, 1.0, None, 1)],
        "id long, status string, ele double, source string, dist double, note string, ts long",
    )
    out = sampling.reviewed(scored, said)
    ids = lambda w: sorted(r.id for r in sampling.shown(out, w).collect())
    assert [ids(w) for w in ("all", "flagged", "approved", "rejected", "pending")] == [[1, 2, 3], [1], [1, 2], [], [3]]
    done = sampling.validated(out).orderBy("osm_id")
    geo.write_csv(done.coalesce(1), str(tmp_path / "out"))
    (file,) = Path(tmp_path / "out").glob("*.csv")
    head, one, two = csv.reader(file.open(newline=""))
    assert head == ["osm_id", "name", "highway", "layer", "ele", "ele_source", "source_dist_m", "terrain", "terrain_gap", "center_lat", "center_lng", "note"]
    assert one == ["1", 'Ponte "A", sul', "primary", "1", "12.3", "manual", "", "5.0", "7.3", "2.5", "1.5", "two\nlines"]
    assert two == ["2", "", "", "0", "10.0", "survey", "3.0", "", "", "4.0", "3.0", ""]
