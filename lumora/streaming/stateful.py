"""Stateful processors on typed state with event-time timers: the evidence ledger as it grows, and leases that expire.

Both need a state store that keeps several variables a key: spark.sql.streaming.stateStore.providerClass names the one on
RocksDB, which `state_store` sets in a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.kernels import LEDGER_SCHEMA, EvidenceLedger

LEASE_SCHEMA = "stream_id long, lease_id string, granted_ms long, ended_ms long, ending string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a batch; longs and ints may be null."""
    columns = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({n: pd.array([r[k] for r in rows], "Int64") if kind in ("long", "int") else pd.Series([r[k] for r in rows], dtype=object) for k, (n, kind) in enumerate(columns)})


class LedgerProcessor(StatefulProcessor):
    """The evidence ledger of each stream. What is open lies in typed state: the selector's position, and lists of unsettled frames, of settled ones that wait, and of windows.

    A stream that has no rows for idle_ms of event time is over: a timer ends it and its state goes.
    """

    def __init__(self, idle_ms: int, policy: dict):
        self.idle_ms, self.policy = idle_ms, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "last long, signature array<long>, text array<long>, selected long, event long, windows long, closed long, post long, window string, seen long, written long, timer long")
        self.ring = handle.getListState("ring", "number long, frame_index long, pts_ms long, decision string, reason string")
        self.ready = handle.getListState("ready", "number long, frame_index long, pts_ms long, decision string, selection string, window_id string, reason string")
        self.windows = handle.getListState("windows", "window_id string, first_number long, last_number long, first_frame long, last_frame long, frames long, closed boolean")

    def _load(self) -> tuple[EvidenceLedger, int | None]:
        ledger = EvidenceLedger(**self.policy)
        if not self.position.exists():
            return ledger, None
        s = ledger.select
        s.last, s.signature, s.text, s.selected, s.event, s.windows, s.closed, s.post, s.window, ledger.seen, ledger.written, timer = self.position.get()
        for number, index, pts, decision, reason in self.ring.get():
            s.ring.append([number, pts, decision, "not_selected", "", reason])
            ledger.frames[number] = index
        for number, *row in self.ready.get():
            ledger.ready[number] = tuple(row)
        for name, first, last, first_index, last_index, n, closed in self.windows.get():
            ledger.windows[name] = [first, last, first_index, last_index, n]
            if closed:
                ledger.closed.add(name)
        return ledger, timer

    def _store(self, ledger: EvidenceLedger, timer: int | None) -> None:
        s = ledger.select
        cells = lambda x: None if x is None else [int(v) for v in x]
        self.position.update((s.last, cells(s.signature), cells(s.text), s.selected, s.event, s.windows, s.closed, s.post, s.window, ledger.seen, ledger.written, timer))
        for state, rows in (
            (self.ring, [(r[0], ledger.frames[r[0]], r[1], r[2], r[5]) for r in s.ring]),
            (self.ready, [(n, *row) for n, row in ledger.ready.items()]),
            (self.windows, [(name, *w, name in ledger.closed) for name, w in ledger.windows.items()]),
        ):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ledger, timer = self._load()
        out = []
        for row in pd.concat(list(rows)).sort_values("frame_index").itertuples(index=False):
            out += [(key[0], *r) for r in ledger.push(row)]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(ledger.select.last or 0) + self.idle_ms
        self.handle.registerTimer(timer)
        self._store(ledger, timer)
        yield _frame(out, LEDGER_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ledger, _ = self._load()
        out = [(key[0], *r) for r in ledger.finish()]
        for state in (self.position, self.ring, self.ready, self.windows):
            state.clear()
        yield _frame(out, LEDGER_SCHEMA)

    def close(self) -> None:
        pass


def growing_ledger(frames: DataFrame, late: str, idle_ms: int, **policy) -> DataFrame:
    """LEDGER_SCHEMA rows of a stream of frames (stream_id, frame_index, pts_ms, signature), frames and windows as soon as they may be read. Event time is pts_ms."""
    timed = frames.withColumn("at", F.timestamp_millis("pts_ms")).withWatermark("at", late)
    return timed.groupBy("stream_id").transformWithStateInPandas(LedgerProcessor(idle_ms, policy), LEDGER_SCHEMA, "Append", "EventTime")


class LeaseProcessor(StatefulProcessor):
    """Leases of each stream: a timer for each ends it at its expiry unless it was released before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "lease_id string", "granted_ms long, expires_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values(["at_ms", "event_id"]).itertuples(index=False):
            lease = (row.lease_id,)
            if row.action == "acquire":
                until = int(row.at_ms) + int(row.ttl_ms)
                self.open.updateValue(lease, (int(row.at_ms), until))
                self.handle.registerTimer(until)
            elif self.open.containsKey(lease):
                granted, until = self.open.getValue(lease)
                if int(row.at_ms) < until:
                    self.open.removeKey(lease)
                    out.append((key[0], row.lease_id, granted, int(row.at_ms), "released"))
        yield _frame(out, LEASE_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (lease,), (granted, expires) in list(self.open.iterator()):
            if expires <= until:
                self.open.removeKey((lease,))
                out.append((key[0], lease, granted, expires, "expired"))
        yield _frame(out, LEASE_SCHEMA)

    def close(self) -> None:
        pass


def ended_leases(events: DataFrame, late: str) -> DataFrame:
    """How each lease of a stream of events (stream_id, event_id, at_ms, action, lease_id, ttl_ms) ended: released, or expired when event time has passed its expiry."""
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("stream_id").transformWithStateInPandas(LeaseProcessor(), LEASE_SCHEMA, "Append", "EventTime")


def lease_ends(events: DataFrame, as_of_ms: int | Column) -> DataFrame:
    """The same over a table: each lease's first grant with its end; outstanding ones (expiry after as_of_ms) have no end."""
    w = Window.partitionBy("stream_id", "lease_id")
    first = lambda action: F.min(F.when(F.col("action") == action, F.struct("at_ms", "event_id", "ttl_ms"))).over(w)
    at = events.withColumn("_g", first("acquire")).where("action = 'acquire' AND event_id = _g.event_id OR action <> 'acquire'").withColumn("_until", F.col("_g.at_ms") + F.col("_g.ttl_ms"))
    after = (F.col("action") == "release") & (F.struct("at_ms", "event_id") > F.struct(F.col("_g.at_ms").alias("at_ms"), F.col("_g.event_id").alias("event_id"))) & (F.col("at_ms") < F.col("_until"))
    out = at.where("_g IS NOT NULL").groupBy("stream_id", "lease_id").agg(F.min("_g.at_ms").alias("granted_ms"), F.min(F.when(after, F.col("at_ms"))).alias("_released"), F.min("_until").alias("_until"))
    ending = F.when(F.col("_released") <= as_of_ms, "released").when(F.col("_until") <= as_of_ms, "expired").otherwise("outstanding")
    return out.select("stream_id", "lease_id", "granted_ms", F.when(ending != "outstanding", F.coalesce("_released", "_until")).alias("ended_ms"), ending.alias("ending"))
