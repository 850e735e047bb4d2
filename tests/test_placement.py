"""Points in rings: the first that is inside, without drawing those after it."""

from __future__ import annotations

import pytest
from kelvora.operators import sampling
from pyspark.sql import functions as F

RINGS = {"ell": [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)], "sliver": [(0, 0), (9, 9), (9, 9.001)], "flat": [(2, 5), (3, 5), (4, 5)]}


def test_first_inside(spark):
    rows = [(d, [{"x": float(x), "y": float(y)} for x, y in RINGS[name]], name) for d, name in enumerate([*["ell"] * 40, "sliver", "flat"])]
    picks = spark.createDataFrame(rows, "d long, ring array<struct<x:double,y:double>>, name string")
    out = sampling.place_inside(picks, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    got = {r.d: (r.x, r.y) for r in out.collect()}
    i = F.col("d") * 8 + F.col("t")
    drawn = spark.range(40).select(F.col("id").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t")).select("d", "t", (4 * sampling.sobol_1d(i)).alias("x"), (3 * sampling.sobol_2d(i)).alias("y"))
    want = {}
    for r in drawn.orderBy("d", "t").collect():
        if r.x < 1 or r.y < 1:
            want.setdefault(r.d, (r.x, r.y))
    assert len(want) == 40 and all(got[d] == pytest.approx(p) for d, p in want.items())
    assert got[41] == (2.0, 5.0) and 0 < got[40][0] < 9 and 0 <= got[40][1] - got[40][0] <= 0.001
