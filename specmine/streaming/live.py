"""Control events as a running stream: leases with their frames, idle spans over several sources.

``LiveLeases`` keeps one controller's lease: its number, whether risky commands are unlocked, and the cells
that were set, by universe. A lease that has been quiet for the timeout ends by an event-time timer, which
puts out a zero frame for every universe the lease has touched, and all its state goes.

Idle spans take two stateful operators in a row. ``Presence`` turns the events of each source of a key (a
lease, a socket, a pending request, each with its own time to live) into moments at which the source becomes
busy and free; ``IdleSpans`` counts the busy sources of a key in order of time. Moments wait in its state until
the watermark has passed them, since one source's end may be told after another one's later start.

Events of a key are put in order within a micro-batch and must come in order across micro-batches, as a
log partitioned by key gives them; results don't depend on where micro-batches end. What a frame holds is a
text of ``channel:value`` for the channels that aren't zero, by channel; an empty text is a zero frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEASE_ROWS = "controller bigint, lease_no int, event_id bigint, ts timestamp, cause string, universe int, frame string, allowed boolean"
MOMENTS = "key bigint, source string, ts timestamp, change int"
SPANS = "key bigint, idle_from timestamp, idle_to timestamp"


def timestamps(micros: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")


def in_order(parts: Iterator[pd.DataFrame], *order: str) -> list[Any]:
    """The rows of a key's micro-batch."""
    return list(pd.concat(list(parts)).sort_values(list(order), kind="stable").itertuples(index=False))


class LiveLeases(StatefulProcessor):
    """Rows of a controller: (controller, us, event_id, action, universe, channel, value, risky)."""

    def __init__(self, timeout_s: int):
        self.timeout = timeout_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "number int, last bigint, unlocked boolean, open boolean")
        self.cells = handle.getMapState("cells", "universe int, channel int", "value int")
        self.touched = handle.getMapState("touched", "universe int", "seen int")

    def _load(self) -> tuple[list, dict]:
        lease = list(self.lease.get()) if self.lease.exists() else [0, 0, False, False]
        frames: dict[int, dict[int, int]] = {u: {} for (u,) in self.touched.keys()} if lease[3] else {}
        if frames:
            for (universe, channel), (value,) in self.cells.iterator():
                frames[universe][channel] = value
        return lease, frames

    def _keep(self, lease: list, frames: dict) -> None:
        self.lease.update(tuple(lease))
        self.cells.clear()
        self.touched.clear()
        for universe, cells in frames.items():
            self.touched.updateValue((universe,), (1,))
            for channel, value in cells.items():
                self.cells.updateValue((universe, channel), (value,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lease[3]:
            self.handle.registerTimer((lease[1] + self.timeout) // 1000 + 1)

    def _expire(self, key: int, lease: list, frames: dict, out: list) -> None:
        for universe in sorted(frames):
            out.append((key, lease[0], None, lease[1] + self.timeout, "expired", universe, "", None))
        frames.clear()
        lease[2] = lease[3] = False

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (key,) = key
        lease, frames = self._load()
        out: list[tuple] = []
        for e in in_order(rows, "us", "event_id"):
            if lease[3] and e.us - lease[1] > self.timeout:
                self._expire(key, lease, frames, out)
            if not lease[3]:
                lease[0], lease[3] = lease[0] + 1, True
            lease[1] = e.us
            out.append((key, lease[0], e.event_id, e.us, "event", None, None, bool(lease[2] or not e.risky)))
            if e.action == "unlock":
                lease[2] = True
            elif e.action in ("end", "blackout"):
                for universe in sorted(frames):
                    frames[universe] = {}
                    out.append((key, lease[0], e.event_id, e.us, e.action, universe, "", None))
            elif e.action == "set" and 1 <= e.channel <= 512 and 0 <= e.value <= 255:
                frame = frames.setdefault(int(e.universe), {})
                frame.pop(int(e.channel), None)
                if e.value:
                    frame[int(e.channel)] = int(e.value)
                text = ",".join(f"{c}:{v}" for c, v in sorted(frame.items()))
                out.append((key, lease[0], e.event_id, e.us, "set", int(e.universe), text, None))
        self._keep(lease, frames)
        yield lease_rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (key,) = key
        lease, frames = self._load()
        out: list[tuple] = []
        if lease[3] and (lease[1] + self.timeout) // 1000 < timerValues.getCurrentWatermarkInMs():
            self._expire(key, lease, frames, out)
            self._keep(lease, frames)
        yield lease_rows(out)

    def close(self) -> None:
        pass


def lease_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["controller", "lease_no", "event_id", "ts", "cause", "universe", "frame", "allowed"])
    return out.astype({"event_id": "Int64", "universe": "Int32", "lease_no": "int32"}).assign(ts=timestamps(out["ts"].tolist()))


def live_leases(commands: DataFrame, timeout_s: int, watermark: str = "0 seconds") -> DataFrame:
    """Of a stream of commands: a row for each event (cause ``event``, with lease number and whether it is allowed), a frame
    for each universe that a command changes (``set``, ``end``, ``blackout``), and zero frames of leases that expire."""
    rows = commands.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("controller").transformWithStateInPandas(LiveLeases(timeout_s), LEASE_ROWS, "Append", "EventTime")


class Presence(StatefulProcessor):
    """Moments at which a source of a key becomes busy (with an event) and free (its time to live behind the last)."""

    def __init__(self, lives: dict[str, int]):
        self.lives = {k: v * 1_000_000 for k, v in lives.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        life, out = self.lives[key[1]], []
        last = self.last.get()[0] if self.last.exists() else None
        for us in sorted(pd.concat(list(rows))["us"].tolist()):
            if last is not None and us - last > life:
                out.append((last + life, -1))
                last = None
            if last is None:
                out.append((us, 1))
            last = us
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + life) // 1000 + 1)
        yield moments(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield moments(key, [(last + self.lives[key[1]], -1)])

    def close(self) -> None:
        pass


def moments(key: tuple, rows: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"key": [key[0]] * len(rows), "source": [key[1]] * len(rows), "ts": timestamps([us for us, _ in rows]), "change": pd.Series([c for _, c in rows], dtype="int32")})


class IdleSpans(StatefulProcessor):
    """Spans over ``timeout_s`` in which no source of a key is busy."""

    def __init__(self, timeout_s: int):
        self.timeout = timeout_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.busy = handle.getValueState("busy", "sources int, since bigint")
        self.waiting = handle.getListState("waiting", "us bigint, change int")

    def _pass(self, key: tuple, told: list[tuple[int, int]], until: int) -> Iterator[pd.DataFrame]:
        """Count what the watermark has passed; the rest waits."""
        told = sorted(told, key=lambda m: (m[0], -m[1]))
        sources, since = self.busy.get() if self.busy.exists() else (0, None)
        spans, later = [], [m for m in told if m[0] // 1000 > until]
        for us, change in told[: len(told) - len(later)]:
            if sources == 0 and change > 0 and since is not None and us - since > self.timeout:
                spans.append((since, us))
            sources += change
            if sources == 0:
                since = us
        self.busy.update((sources, since))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            at = later[0][0] // 1000
            if at not in list(self.handle.listTimers()):
                self.handle.registerTimer(at)
        yield pd.DataFrame({"key": [key[0]] * len(spans), "idle_from": timestamps([a for a, _ in spans]), "idle_to": timestamps([b for _, b in spans])})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        told = [(int(us), int(c)) for us, c in zip(new["us"].tolist(), new["change"].tolist())]
        yield from self._pass(key, [*((us, c) for us, c in self.waiting.get()), *told], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, list(self.waiting.get()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def idle_spans(events: DataFrame, lives: dict[str, int], timeout_s: int, watermark: str = "0 seconds") -> DataFrame:
    """Of a stream (key, source, ts): spans over the timeout without any busy source, from the end of the last to the
    start of the next. ``lives``: seconds that an event keeps its source busy; other sources are left out."""
    rows = events.where(F.col("source").isin(*lives)).withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    told = rows.groupBy("key", "source").transformWithStateInPandas(Presence(lives), MOMENTS, "Append", "EventTime", eventTimeColumnName="ts")
    return told.withColumn("us", F.unix_micros("ts")).groupBy("key").transformWithStateInPandas(IdleSpans(timeout_s), SPANS, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which map and list state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_in_parts(spark: SparkSession, parts: list[DataFrame], build: Callable[..., DataFrame], folder: str) -> DataFrame:
    """What ``build`` makes of a stream that is fed part by part, its query stopped and started again from its
    checkpoint between them: each start takes all that is there and ends. The sink's rows."""
    schema = parts[0].schema
    with state_store(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/in")
            out = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
