"""Guard, recent set and watchdog as streams with state per machine: what ``lifecycle`` answers over a whole table.

Events come in any order; each is taken in the order of time once the watermark has passed it, so that a replay gives the
batch's rows however its events were dealt to triggers, and an event later than the watermark allows is left out. What a
machine keeps is its events of the last minutes, the leases that hold, the newest clients or one run. Alarms are timers, so
that the watchdog stops a machine of which nothing more is heard.

The state needs the RocksDB store, which these functions turn on for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from kelvora.streaming.lifecycle import IDLE_S, LEASE_S, NEWEST, RECENT_S, UP_S, run_end

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "at bigint, kind string, id bigint, client bigint"
SECOND = 1_000_000


class Ordered(StatefulProcessor):
    """Takes a machine's events (at in microseconds, kind, id, client) in order of time. What is done with them, and when to
    wake without one, is the subclass's."""

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.due = handle.getValueState("due", "ms bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise TypeError("a subclass names its state")

    def taken(self, events: list[tuple], upto: int) -> list[tuple]:
        """Rows of these events, all that there are up to a time."""
        raise TypeError("a subclass takes events")

    def alarm(self) -> int | None:
        """When to wake if nothing comes."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for batch in rows for r in batch[["at", "kind", "id", "client"]].itertuples(index=False)]
        if new:
            self.waiting.appendList([(int(a), k, None if i is None else int(i), None if c is None else int(c)) for a, k, i, c in new])
            self._wake(min(int(r[0]) for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        # Keepalives come before what asks at the same instant.
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1] != "beat", e[2] or 0))
        ready, rest = [e for e in events if e[0] <= upto], [e for e in events if e[0] > upto]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        out = self.taken(ready, upto)
        marks = [x for x in (rest[0][0] if rest else None, self.alarm()) if x is not None]
        if marks:
            self._wake(max(min(marks), upto + 1))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["machine", *self.columns])

    def _wake(self, at: int) -> None:
        """One timer a machine, at the first thing that it waits for."""
        ms = -(-at // 1000)
        if self.due.exists():
            (held,) = self.due.get()
            if held <= ms:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def close(self) -> None:
        pass


class Guard(Ordered):
    columns = ("id", "client", "blocked")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.leases = handle.getMapState("leases", "client bigint", "until bigint")

    def taken(self, events: list[tuple], upto: int) -> list[tuple]:
        held = {k[0]: v[0] for k, v in self.leases.iterator()}
        before, out = {**held}, []
        for at, kind, id_, client in events:
            held = {c: u for c, u in held.items() if u > at}
            if kind == "beat":
                held[client] = at + LEASE_S * SECOND
            else:
                out.append((id_, client, any(c != client for c in held)))
        for c in before.keys() - held.keys():
            self.leases.removeKey((c,))
        for c, u in held.items():
            if before.get(c) != u:
                self.leases.updateValue((c,), (u,))
        return out


class Recent(Ordered):
    columns = ("id", "rank", "client", "last_us")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "client bigint, last bigint")

    def taken(self, events: list[tuple], upto: int) -> list[tuple]:
        seen, out = dict(self.seen.get()), []
        for at, kind, id_, client in events:
            if kind == "beat":
                seen[client] = at
            # A client that eight others have been seen after can only come back by being seen.
            newest = sorted(((c, t) for c, t in seen.items() if at - t <= RECENT_S * SECOND), key=lambda x: (-x[1], x[0]))
            if kind == "beat":
                # Of clients seen at the same instant all are kept until it is over: ties go to the smaller client.
                seen = dict(newest[:NEWEST] + [x for x in newest[NEWEST:] if x[1] == newest[NEWEST - 1][1]])
            else:
                out += [(id_, k + 1, c, t) for k, (c, t) in enumerate(newest[:NEWEST])]
        self.seen.put(list(seen.items())) if seen else self.seen.clear()
        return out


class Watchdog(Ordered):
    columns = ("boot_us", "at_us", "action")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "boot bigint, last bigint")

    def taken(self, events: list[tuple], upto: int) -> list[tuple]:
        run, out = self.run.get() if self.run.exists() else None, []
        for at in [*(e[0] for e in events), None]:
            # A stop is due once time has gone past it.
            if run is not None and run_end(*run)[0] < (upto if at is None else at):
                out.append((run[0], *run_end(*run)))
                run = None
            if at is not None:
                run = (at, at) if run is None else (run[0], at)
        self.run.update(run) if run is not None else self.run.clear()
        return out

    def alarm(self) -> int | None:
        return run_end(*self.run.get())[0] + 1 if self.run.exists() else None


def _stream(events: DataFrame, processor: Ordered, late: str, schema: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own = events.select("machine", "ts", F.unix_micros("ts").alias("at"), "kind", F.col("id").cast("bigint").alias("id"), F.col("client").cast("bigint").alias("client"))
    return own.withWatermark("ts", late).groupBy("machine").transformWithStateInPandas(processor, f"machine bigint, {schema}", "Append", "EventTime")


def guard_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(machine, id, client, blocked) of each stop among events (machine, ts, kind beat or stop, id, client): whether another
    client's lease holds on the machine then. As ``lifecycle.other_active``."""
    return _stream(events, Guard(), late, "id bigint, client bigint, blocked boolean")


def recent_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(machine, id, rank, client, last_us): the newest clients of a machine at each event of kind ask. As
    ``lifecycle.newest_clients``."""
    return _stream(events, Recent(), late, "id bigint, rank int, client bigint, last_us bigint")


def watchdog_stream(beats: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(machine, boot_us, at_us, action): when machines of keepalives (machine, ts) are stopped, and why, whether or not
    anything comes after. As ``lifecycle.watchdog_stops``."""
    own = beats.select("machine", "ts", F.lit("beat").alias("kind"), F.lit(None).alias("id"), F.lit(None).alias("client"))
    return _stream(own, Watchdog(), late, "boot_us bigint, at_us bigint, action string")
