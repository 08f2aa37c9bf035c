"""Sessions that end when nothing touches them for a while, as state with event-time timers.

A session is a key's activity without a pause longer than its time to live; when the watermark has passed its last touch by
that time, it is expired: it comes out, and its state goes.  State is kept by key as intervals that are merged when a
touch falls between them, so the result does not depend on how events are cut into micro-batches, nor on their order within
the watermark's delay.  A key has one timer, of its first interval to end; when it fires, all intervals that the watermark has
passed come out at once, and the next one gets the timer.  So a key's intervals are read and written once a micro-batch at
most, however many they are, and an interval lives at most one micro-batch longer than the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkflow.streaming.streams import _events, drained

#: Fixed value: how long a session lives.
LIFE_SECONDS = 3600
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INTERVALS = "opened long, last long, n long"
EXPIRED = "session string, opened long, last long, n long"


def merged(intervals: list[tuple[int, int, int]], life: int) -> list[tuple[int, int, int]]:
    """Intervals (opened, last, n), those with pauses of at most `life` between them as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(intervals):
        if out and a - out[-1][1] <= life:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


class Expiry(StatefulProcessor):
    """Times are microseconds; timers are the next whole millisecond."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", INTERVALS)

    def _keep(self, intervals: list[tuple[int, int, int]]) -> None:
        """Intervals in order: the first one ends first."""
        if intervals:
            self.open.put(intervals)
            self.handle.registerTimer((intervals[0][1] + self.life) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.open.get()]
        if held:  # its timer may go to another time
            self.handle.deleteTimer((held[0][1] + self.life) // 1000 + 1)
        self._keep(merged([*held, *((r.at, r.at, r.n) for r in rows)], self.life))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        intervals = [tuple(r) for r in self.open.get()]
        self._keep([i for i in intervals if i[1] + self.life >= passed])
        for opened, last, n in intervals:
            if last + self.life < passed:
                yield Row(session=key[0], opened=opened, last=last, n=n)

    def close(self) -> None:
        pass


def expired_sessions(events: DataFrame, session: str, life_seconds: int = LIFE_SECONDS, delay: str = "1 day"):
    """EXPIRED rows of a stream with event time `ts`, and the query that ended it.  Null sessions are one session.  A key's
    touches of one micro-batch come to one task as two numbers each; a source that limits its micro-batches bounds them."""
    spark = events.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)

    def build(rows: DataFrame) -> DataFrame:
        touches = rows.select(F.col(session).cast("string").alias("session"), F.unix_micros("ts").alias("at"), F.lit(1).cast("long").alias("n"), "ts")
        return touches.groupBy("session").transformWithState(Expiry(life_seconds * 1_000_000), EXPIRED, "append", "eventTime")

    try:
        return drained(events, build, "expiry", delay)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stream_session_expiry(spark, sf_dir):
    """Expired sessions of users: opened, last touched and expired (milliseconds of the last touch and an hour)."""
    out, _ = expired_sessions(_events(spark, sf_dir), "user_id")
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSS")
    return out.select(F.col("session").cast("long").alias("user_id"), stamp(F.col("opened")).alias("opened"), stamp(F.col("last")).alias("last_seen"), stamp(F.col("last") + LIFE_SECONDS * 1_000_000).alias("expired"), "n")


CATALOGUE = {
    "stream_session_expiry": (stream_session_expiry, """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS opened, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_seen, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%g') AS expired, count(*) AS n FROM s GROUP BY user_id, k"""),
}
