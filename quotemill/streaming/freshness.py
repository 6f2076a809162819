"""Freshness as a stream: an alert comes out because nothing came in.

Per table the state holds the newest settled time and the few later times that still matter. A
timer stands at the end of the allowed silence; when the watermark passes it and no row came, the
alert is sent. Afterwards the state is given up, so a table that never comes back holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.functions.times import instant_to_utc
from quotemill.streaming.jobs import EVENT_TIME, with_event_time

ALERTS = "table_name STRING, last_seen TIMESTAMP, alert_at TIMESTAMP"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stepping_stones(times: list[int], limit: int) -> list[int]:
    """The times that decide where gaps above `limit` lie, whatever times are added later.

    A time between two kept ones that are at most `limit` apart begins and ends no such gap.
    """
    out: list[int] = []
    for time in sorted(set(times)):
        while len(out) > 1 and time - out[-2] <= limit:
            out.pop()
        out.append(time)
    return out


def settle(last: int | None, times: list[int], watermark: int, limit: int) -> tuple[list[int], int | None, list[int]]:
    """(last times before closed gaps, the new last time or None, times still open).

    Times up to the watermark are settled: no row before it can come any more. A silence that
    ends at or before the watermark is a closed gap even if nothing has come after it.
    """
    gaps = []
    times = sorted(times)
    for time in [t for t in times if t <= watermark]:
        if last is not None and time - last > limit:
            gaps.append(last)
        last = time if last is None else max(last, time)
    if last is not None and last + limit < watermark:
        gaps.append(last)
        last = None
    return gaps, last, [t for t in times if t > watermark]


class Silence(StatefulProcessor):
    """Sends (table, last time, alert time) for every silence of more than `limit` microseconds."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us BIGINT")
        self.open = handle.getValueState("open", "us ARRAY<BIGINT>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = stepping_stones([*self._open(), *(row["us"] for row in rows)], self.limit)
        yield from self._advance(key, times, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, self._open(), timerValues)

    def close(self) -> None:
        pass

    def _open(self) -> list[int]:
        return list(self.open.get()[0]) if self.open.exists() else []

    def _advance(self, key, times: list[int], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        gaps, last, times = settle(last, times, timerValues.getCurrentWatermarkInMs() * 1000, self.limit)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for state, value in ((self.last, last), (self.open, times or None)):
            state.clear() if value is None else state.update((value,))
        # The next moment something can change: an open time is settled, or the silence is over.
        due = [t for t in ((last + self.limit + 1) if last is not None else None, min(times, default=None)) if t is not None]
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        at = lambda us: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
        for gap in gaps:
            yield Row(table_name=key[0], last_seen=at(gap), alert_at=at(gap + self.limit))


def freshness_stream(rows: DataFrame, minutes: int = 15, delay: str = "15 minutes") -> DataFrame:
    """(table_name, last_seen, alert_at) for every silence of (table_name, timestamp) rows.

    An alert is sent once the watermark has passed the end of the allowed silence, whether or not
    the table comes back. Times count to the microsecond. Rows without a table or a time have no
    part; rows later than the watermark are dropped. Run it within `rocks_state`.
    """
    known = rows.where("table_name IS NOT NULL AND timestamp IS NOT NULL").select("table_name", "timestamp")
    timed = with_event_time(known, "timestamp", delay)
    keyed = timed.select("table_name", EVENT_TIME, F.unix_micros(EVENT_TIME).alias("us"))
    limit = int(timedelta(minutes=minutes).total_seconds() * 1_000_000)
    alerts = keyed.groupBy("table_name").transformWithState(
        statefulProcessor=Silence(limit), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime"
    )
    return alerts.select("table_name", instant_to_utc(F.col("last_seen")).alias("last_seen"), instant_to_utc(F.col("alert_at")).alias("alert_at"))


@contextmanager
def rocks_state(spark: SparkSession):
    """Timers need the RocksDB state store; the session's setting comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
