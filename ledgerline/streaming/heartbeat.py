"""Signs of life while a stream is silent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ledgerline.fixed_values import HEARTBEAT_MS, HEARTBEAT_SLACK_MS
from ledgerline.functions.text import format_elapsed
from ledgerline.streaming.keyed import use_rocksdb

_TIMES = T.StructType([T.StructField("started_ms", T.LongType()), T.StructField("last_ms", T.LongType())])


class _Beats(StatefulProcessor):
    """Timers in processing time: one per key, set anew by every beat until the key is given up."""

    def __init__(self, keys: list[str], interval: int, slack: int, ttl: int):
        self.keys, self.interval, self.slack, self.ttl = keys, interval, slack, ttl

    def init(self, handle):
        self.handle = handle
        # the state of a key that nothing is heard of ends by itself
        self.times = handle.getValueState("times", _TIMES, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        for _ in rows:
            pass
        if not self.times.exists():
            self.handle.registerTimer(now + self.interval)
            self.times.update((now, now))
        else:
            self.times.update((self.times.get()[0], now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.times.exists():  # silent for too long: no state, no further timer
            return iter(())
        now, (started, last) = timerValues.getCurrentProcessingTimeInMs(), tuple(self.times.get())
        self.handle.registerTimer(now + self.interval)
        if now - last < self.interval - self.slack:
            return iter(())
        return iter([Row(*self.keys, "elapsed_ms", "idle_ms")(*key, now - started, now - last)])

    def close(self):
        pass


def heartbeats_stream(
    rows: DataFrame, key: Sequence[str], interval_ms: int = HEARTBEAT_MS, slack_ms: int = HEARTBEAT_SLACK_MS, ttl_ms: int = 3_600_000
) -> DataFrame:
    """``key``, ``elapsed_ms`` since its first row, ``idle_ms`` since its last one, and ``message`` (``still running 1m 5s``).

    While a key is silent a row comes every ``interval_ms``, by the clock of the machines, also when nothing at all
    comes in; rows in between keep it quiet, up to ``slack_ms`` before the interval is over. A key silent for ``ttl_ms``
    is forgotten and begins anew with its next row. Needs a processing-time trigger: a stream that has stopped says
    nothing.
    """
    use_rocksdb(rows.sparkSession)
    key = [key] if isinstance(key, str) else list(key)
    out = T.StructType([*[rows.schema[k] for k in key], T.StructField("elapsed_ms", T.LongType()), T.StructField("idle_ms", T.LongType())])
    beats = rows.select(*key).groupBy(*key).transformWithState(
        statefulProcessor=_Beats(key, interval_ms, slack_ms, ttl_ms), outputStructType=out, outputMode="Update", timeMode="ProcessingTime"
    )
    return beats.withColumn("message", F.concat(F.lit("still running "), format_elapsed(F.col("elapsed_ms") / 1000)))
