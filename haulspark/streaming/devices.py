"""Devices as keyed state of a stream: spacing of pings, the last fix, and when it is stale.

Each has a batch form of the same meaning.  State lives in RocksDB, whose changes are part of the query's checkpoint,
so a query that is started again goes on where it was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds in the state and what leaves it.
STATE = "device_id {kind}, at bigint, lon double, lat double, speed_kph double, ping_count bigint, live boolean"


def keep_state(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Spacing(StatefulProcessor):
    """Marks a ping as limited that arrives sooner after the device's last allowed one than allowed."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["ping_id"])):
            limited = last is not None and r["at"] - last < self.wait
            if not limited:
                last = r["at"]
            yield Row(device_id=key[0], ping_id=r["ping_id"], at=r["at"], rate_limited=limited)
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def spaced(pings: DataFrame, seconds: float = 5) -> DataFrame:
    """(device_id, ping_id, received_at, rate_limited) of pings that were let in so far, in the order of arrival, ties
    by ping_id; a limited ping doesn't put off the next one.  Pings without an arrival are left out.

    As a stream, a micro-batch is put in order and goes on from the state; arrivals of later ones should not be
    earlier.  As a batch, a device's pings pass one task one after the other, since each depends on the one before;
    nothing is gathered.
    """
    p = pings.where("received_at is not null").selectExpr("device_id", "cast(ping_id as bigint) as ping_id", "unix_micros(cast(received_at as timestamp)) as at")
    kind = dict(p.dtypes)["device_id"]
    schema = f"device_id {kind}, ping_id bigint, at bigint, rate_limited boolean"
    if p.isStreaming:
        keep_state(p.sparkSession)
        marked = p.groupBy("device_id").transformWithState(Spacing(seconds), schema, outputMode="Append", timeMode="None")
        return marked.selectExpr("device_id", "ping_id", "timestamp_micros(at) as received_at", "rate_limited")
    wait = int(seconds * 1_000_000)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, last, begun = None, 0, False
        for b in batches:
            limited = []
            for d, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or d != device:
                    device, begun, late = d, True, False
                else:
                    late = at - last < wait
                if not late:
                    last = at
                limited.append(late)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(limited, pa.bool_())], names=[*b.schema.names, "rate_limited"])

    marked = p.repartition("device_id").sortWithinPartitions("device_id", "at", "ping_id").mapInArrow(mark, schema)
    return marked.selectExpr("device_id", "ping_id", "timestamp_micros(at) as received_at", "rate_limited")


class LastFix(StatefulProcessor):
    """The latest fix of a device and its count; a timer says when it is stale, and silence ends it."""

    def __init__(self, seconds: float, forget: dt.timedelta):
        self.stale, self.ttl = int(seconds * 1000), int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fix = handle.getValueState("fix", "at bigint, ping_id bigint, lon double, lat double, speed_kph double, ping_count bigint, due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.fix.get() if self.fix.exists() else None
        best = tuple(held)[:5] if held else None
        count, due = (held[5], held[6]) if held else (0, -1)
        for r in rows:
            count += 1
            new = (r["at"], r["ping_id"], r["lon"], r["lat"], r["speed_kph"])
            if best is None or new[:2] > best[:2]:
                best = new
        at = self._due(best)
        if at != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
        self.fix.update((*best, count, at))
        yield self._row(key, best, count, timerValues.getCurrentWatermarkInMs() < at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *best, count, due = self.fix.get()
        if self._due(best) < due:  # it was stale before and silent since
            self.fix.clear()
            return
        self.handle.registerTimer(due + self.ttl)
        self.fix.update((*best, count, due + self.ttl))
        yield self._row(key, best, count, False)

    def _due(self, best) -> int:
        """The first millisecond at which a fix is older than it may be."""
        return best[0] // 1000 + self.stale + 1

    def _row(self, key, best, count, live) -> Row:
        return Row(device_id=key[0], at=best[0], lon=best[2], lat=best[3], speed_kph=best[4], ping_count=count, live=live)

    def close(self) -> None:
        pass


def device_states(fixes: DataFrame, seconds: float = 180, watermark: str = "1 minute", forget: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """A stream of each device's state whenever it changes: its latest fix, how many there were, and ``live``, which a
    timer turns to false once the stream's time is ``seconds`` past that fix.  A device that is silent for ``forget``
    more is forgotten.  The last row of a device says what ``tracking.last_state`` says of all its fixes.
    """
    keep_state(fixes.sparkSession)
    f = fixes.selectExpr("device_id", "cast(ping_id as bigint) as ping_id", "cast(observed_at as timestamp) as observed_at", "unix_micros(cast(observed_at as timestamp)) as at", "lon", "lat", "speed_kph")
    f = f.where("at is not null")
    schema = STATE.format(kind=dict(f.dtypes)["device_id"])
    states = f.withWatermark("observed_at", watermark).groupBy("device_id").transformWithState(LastFix(seconds, forget), schema, outputMode="Update", timeMode="EventTime")
    return states.selectExpr("device_id", "timestamp_micros(at) as observed_at", "lon", "lat", "speed_kph", "ping_count", "live")
