"""Streams with timers: replays equal the batch operators and plain versions, whatever order the events come in."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelvora.streaming import lifecycle, live

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "machine long, ts timestamp, kind string, id long, client long"
US = 1_000_000


def us(s: float) -> int:
    return int(BEGIN.timestamp()) * US + round(s * US)


def replay(spark, folder, name, make, rows, triggers=3, last=10**6):
    """Rows (machine, second, kind, id, client), dealt to files that are read one a trigger; a late end moves the watermark on."""
    def put(k, some):
        frame = pd.DataFrame([(m, BEGIN + timedelta(seconds=s), kind, i, c) for m, s, kind, i, c in some], columns=["machine", "ts", "kind", "id", "client"])
        spark.createDataFrame(frame, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")

    size = -(-len(rows) // triggers)
    out = []
    for k in range(0, len(rows), size):
        put(k, rows[k : k + size])
    put("z", [(-1, last, "beat", None, 0)])
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"))
    run = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    out = spark.table(name).where("machine >= 0").collect()
    return sorted(tuple(r) for r in out)


def shuffled(rng, rows, window):
    """In the order in which they come: up to window seconds late."""
    return [r for _, r in sorted((r[1] + rng.random() * window, r) for r in rows)]


@pytest.fixture(scope="module")
def events():
    rng = random.Random(9)
    rows, second = [], {0: 0.0, 1: 0.0, 2: 50.0}
    for i in range(260):
        m = rng.choice((0, 0, 1, 2))
        second[m] += rng.choice((0, 20, 60, 170, 180, 200, 950, 900))
        rows.append((m, second[m], rng.choice(("beat", "beat", "stop")), i, rng.randint(1, 12)))
    return rows


def test_guard_as_batch(spark, tmp_path, events):
    rng = random.Random(1)
    got = replay(spark, tmp_path, "guard_out", lambda e: live.guard_stream(e, "10 minutes"), shuffled(rng, events, 300))
    want = []
    for m, s, kind, i, c in events:
        if kind == "stop":
            want.append((m, i, c, any(k == "beat" and mm == m and cc != c and t <= s < t + 180 for mm, t, k, _, cc in events)))
    assert got == sorted(want) and len({w[3] for w in want}) == 2
    one = [(0, *e[1:]) for e in events if e[0] == 0]  # the batch operator has one machine
    df = spark.createDataFrame([(i, c, BEGIN + timedelta(seconds=s), k) for _, s, k, i, c in one], "id long, client long, ts timestamp, kind string")
    lease = lifecycle.leases(df.where("kind = 'beat'")).select("client", F.col("begin").cast("timestamp").alias("begin"), F.col("end").cast("timestamp").alias("end"))
    batch = lifecycle.other_active(df.where("kind = 'stop'").select("id", "client", "ts"), lease)
    assert sorted((r.id, r.blocked) for r in batch.collect()) == sorted((i, b) for m, i, _, b in got if m == 0)


def test_recent_as_batch(spark, tmp_path, events):
    rng = random.Random(2)
    asked = [(m, s, "ask" if k == "stop" else k, i, c) for m, s, k, i, c in events]
    got = replay(spark, tmp_path, "recent_out", lambda e: live.recent_stream(e, "10 minutes"), shuffled(rng, asked, 300))
    want, most = [], 0
    for m, s, kind, i, _ in asked:
        if kind == "ask":
            last: dict = {}
            for mm, t, k, _, c in asked:
                if mm == m and k == "beat" and t <= s:
                    last[c] = max(t, last.get(c, t))
            own = sorted(((c, t) for c, t in last.items() if s - t <= 7200), key=lambda x: (-x[1], x[0]))
            most = max(most, len(own))
            want += [(m, i, k + 1, c, us(t)) for k, (c, t) in enumerate(own[:8])]
    assert got == sorted(want) and most > 8


def _stops(seconds, until):
    """One machine's stops, second by second."""
    out, boot, last = [], None, None
    marks = sorted({int(s) for s in seconds})
    for now in range(marks[0], int(until) + 1):
        if boot is not None and now > boot + 7200:
            out.append((boot, boot + 7200, "stop-uptime"))
            boot = None
        elif boot is not None and now > last + 900:
            out.append((boot, last + 900, "stop-idle"))
            boot = None
        if now in seconds:
            boot, last = (now if boot is None else boot), now
    return out


def test_watchdog_fires_without_an_event(spark, tmp_path, events):
    rng = random.Random(3)
    beats = [(m, s, "beat", None, None) for m, s, *_ in events] + [(3, s, "beat", None, None) for s in range(0, 30_000, 600)]
    end = max(s for _, s, *_ in beats) + 20_000
    got = replay(spark, tmp_path, "watchdog_out", lambda e: live.watchdog_stream(e.select("machine", "ts"), "10 minutes"), shuffled(rng, beats, 300), last=end + 600)
    want = sorted((m, us(a), us(b), why) for m in range(4) for a, b, why in _stops({s for mm, s, *_ in beats if mm == m}, end))
    assert got == want and {w[3] for w in want} == {"stop-idle", "stop-uptime"}
    df = spark.createDataFrame([(m, BEGIN + timedelta(seconds=s)) for m, s, *_ in beats], "machine long, ts timestamp")
    assert sorted(tuple(r) for r in lifecycle.watchdog_stops(df, us(end)).collect()) == want


def test_late_events_are_left_out(spark, tmp_path):
    """A keepalive that comes after the watermark has passed it neither blocks nor starts a run."""
    early = [(0, 1000, "beat", None, 1), (0, 1100, "stop", 1, 2), (0, 5000, "beat", None, 5), (0, 9000, "stop", 2, 2), (0, 8990, "beat", None, 1)]
    late = [(0, 2000, "beat", None, 7), (0, 2001, "stop", 9, 2), (0, 9500, "stop", 3, 2)]
    got = replay(spark, tmp_path, "late_out", lambda e: live.guard_stream(e, "1 minute"), early + late, triggers=8)
    assert got == [(0, 1, 2, True), (0, 2, 2, True), (0, 3, 2, False)]
