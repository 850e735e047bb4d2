"""Sessions and state over keepalives (client, ts): the batch form of each operator, and its stream.

The streams are event-time analogues: a lease is a session whose gap is its time to live, and late keepalives are held
against the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvora.operators.order import running_sum

LEASE_S, IDLE_S, UP_S, RECENT_S, NEWEST, DELETE_DAYS = 180, 900, 7200, 7200, 8, 30


def leases(beats: DataFrame, seconds: int = LEASE_S) -> DataFrame:
    """(client, begin, end, beats): runs of keepalives less than ``seconds`` apart; end is the lease's expiry. Also for
    streams, on a frame with a watermark."""
    w = F.session_window("ts", f"{seconds} seconds")
    return beats.groupBy("client", w).agg(F.count("*").alias("beats")).select("client", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "beats")


def lease_stream(beats: DataFrame, late: str = "10 minutes", seconds: int = LEASE_S) -> DataFrame:
    return leases(beats.withWatermark("ts", late), seconds)


def other_active(stops: DataFrame, lease: DataFrame) -> DataFrame:
    """(id, blocked): whether a different client's lease holds at each stop (id, client, ts). Leases that have begun less
    those that have ended hold at a stop; the client's own is taken off. Stops and leases are never paired."""
    change = lambda at, n: lease.select(F.lit(None).cast("bigint").alias("id"), "client", F.col(at).alias("at"), F.lit(0).alias("kind"), F.lit(n).alias("n"))
    asked = stops.select("id", "client", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("n"))
    whole = running_sum(change("begin", 1).union(change("end", -1)).union(asked), ["at", "kind"], "n", "all")
    own = F.sum("n").over(Window.partitionBy("client").orderBy("at", "kind"))
    return whole.withColumn("own", own).where("kind = 1").select("id", (F.col("all") > F.col("own")).alias("blocked"))


def newest_clients(beats: DataFrame, now: Column, keep: int = NEWEST, age_s: int = RECENT_S) -> DataFrame:
    """(client, last): the clients seen last, not before age_s ago; a feature's own limit."""
    last = beats.groupBy("client").agg(F.max("ts").alias("last"))
    recent = last.where(F.unix_timestamp(now) - F.unix_timestamp("last") <= age_s)
    return recent.orderBy(F.col("last").desc(), "client").limit(keep)


def idle_gaps(beats: DataFrame, idle_s: int = IDLE_S) -> DataFrame:
    """(client, ts, gap_s): keepalives after more than idle_s without one."""
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("client").orderBy("ts")))
    return beats.select("client", "ts", gap.alias("gap_s")).where(F.col("gap_s") > idle_s)


def watchdog(idle_s: Column, up_s: Column) -> Column:
    """What to do: stop when idle or up for too long; an unknown idle time is busy."""
    return F.when(up_s > UP_S, "stop-uptime").when(idle_s.isNull(), "busy").when(idle_s > IDLE_S, "stop-idle").otherwise("keep")


def run_end(boot: int, last: int) -> tuple[int, str]:
    """When a machine is stopped, in microseconds, that runs since boot and was last heard at last: the ceiling of its uptime
    comes first where both are due at once."""
    up, idle = boot + UP_S * 1_000_000, last + IDLE_S * 1_000_000
    return (up, "stop-uptime") if up <= idle else (idle, "stop-idle")


def watchdog_stops(beats: DataFrame, until: int) -> DataFrame:
    """(machine, boot_us, at_us, action): a machine's runs over keepalives (machine, ts), each from its first keepalive until
    it was idle or up for too long, as far as time has gone past that (until, in microseconds). Keepalives are folded in order
    as they stream through a task, so a machine with very many is held no more than one with few."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, own = None, None
        for batch in batches:
            out = []
            for machine, at in zip(batch["machine"], batch["at"], strict=True):
                if machine != own:
                    if run is not None and run_end(*run)[0] < until:
                        out.append((own, run[0], *run_end(*run)))
                    run, own = None, machine
                if run is not None and run_end(*run)[0] < at:
                    out.append((own, run[0], *run_end(*run)))
                    run = None
                run = (at, at) if run is None else (run[0], at)
            yield pd.DataFrame(out, columns=["machine", "boot_us", "at_us", "action"])
        if run is not None and run_end(*run)[0] < until:
            yield pd.DataFrame([(own, run[0], *run_end(*run))], columns=["machine", "boot_us", "at_us", "action"])

    own = beats.select("machine", F.unix_micros("ts").alias("at")).where(F.col("at") <= until).repartition("machine").sortWithinPartitions("machine", "at")
    return own.mapInPandas(fold, "machine bigint, boot_us bigint, at_us bigint, action string")


def reaper(state: Column, stopped: Column, now: Column) -> Column:
    days = (F.unix_timestamp(now) - F.unix_timestamp(stopped)) / 86400
    return F.when(state != "STOPPED", "not-stopped").when(stopped.isNull(), "unknown-age").when(days > DELETE_DAYS, "delete").otherwise("too-young")


def eta_s(state: Column) -> Column:
    """Seconds until a machine in this state serves."""
    return F.when(state == "ABSENT", 240).when(state == "STOPPED", 60).when(state == "STARTING", 30).when(state == "RUNNING", 0)


#: Half of a correction is kept at a run, so that what is left of one this many runs ago is below a double's last digit.
EMA_RUNS = 64


def ema(runs: DataFrame) -> DataFrame:
    """(client, corr): half the old correction and half the held ratio of actual to predicted time, in order of seq. Only a
    client's last EMA_RUNS runs bear on a double, so no more of them are gathered."""
    hold = lambda x: F.greatest(F.lit(0.2), F.least(F.lit(5.0), x))
    last = runs.withColumn("back", F.row_number().over(Window.partitionBy("client").orderBy(F.col("seq").desc()))).where(F.col("back") <= EMA_RUNS)
    rows = last.groupBy("client").agg(F.sort_array(F.collect_list(F.struct("seq", "actual", "predicted"))).alias("r"))
    return rows.select("client", F.aggregate("r", F.lit(1.0), lambda acc, x: hold(0.5 * acc + 0.5 * hold(x["actual"] / x["predicted"]))).alias("corr"))


def ema_stream(runs: DataFrame) -> DataFrame:
    """The same as a stream with state per client; runs of one trigger are taken in order of seq."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (corr,) = state.get if state.exists else (1.0,)
        rows = pd.concat(list(batches)).sort_values("seq")
        for actual, predicted in zip(rows["actual"], rows["predicted"], strict=True):
            corr = min(5.0, max(0.2, 0.5 * corr + 0.5 * min(5.0, max(0.2, actual / predicted))))
        state.update((corr,))
        yield pd.DataFrame({"client": [key[0]], "corr": [corr]})

    return runs.groupBy("client").applyInPandasWithState(step, "client bigint, corr double", "corr double", "update", GroupStateTimeout.NoTimeout)


def estimate(refs: Column, e_max: Column, cells: Column, cores: int, mem_bytes: float, rate: float = 3300.0, c: float = 1.0, p: float = 2.0) -> Column:
    """Milliseconds for density over refs: cells reached grow as a power of the budget, slices share the work."""
    explored = F.least(cells, F.lit(c) * F.pow(e_max, F.lit(p)))
    slices = F.least(refs, F.lit(cores), F.greatest(F.lit(1), F.floor(F.lit(mem_bytes) / (37 * cells))))
    return refs * explored / F.lit(rate) / slices
