"""The ordered folds on streams.

Rows may come out of order. They wait in state until the watermark has passed them and are then
folded in (time, tie) order, so any split into micro-batches gives what the batch operator gives.
A row later than the watermark is not dropped: it comes out at once, marked ``late``, and changes nothing. A row
without a time comes out at once too, with nulls, as the batch operators have it. So every row of the input is emitted,
waiting or late. State lives in RocksDB and the query's checkpoint, grouped by buckets of keys; a key whose state has gone
stale is forgotten.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ledgerline.fixed_values import HEARTBEAT_MS, HEARTBEAT_SLACK_MS, REPEAT_GAP_MS
from ledgerline.operators.activity import Idle, Repeats
from ledgerline.operators.folds import Fold
from ledgerline.operators.queue import Leases
from ledgerline.operators.ratelimit import SlidingWindow, TokenBucket

EVENT_TIME = "event_time"
#: Column of all streams here: whether the row came after the watermark had passed its time.
LATE = "late"
#: Buckets of keys that state is grouped by, and rows of a chunk that waits in it. A checkpoint holds for the number it began with.
BUCKETS, _CHUNK = 1024, 10_000
_BUCKET = "_bucket"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary stateful processing needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _FoldProcessor(StatefulProcessor):
    """Folds the keys of a bucket. A call of the state store costs as much as many rows, and so does a group's way in and out
    of Python: so rows wait in chunks, a bucket's keys come due together, and their states are read and written as one.
    """

    def __init__(self, fold: Fold, keys: list[str], ts: str, order: list[str], rows: T.StructType):
        at = rows.names.index
        self.fold, self.rows, self.at = fold, rows, at(ts)
        self.key, self.place, self.inputs = [at(c) for c in keys], [at(c) for c in order], [at(c) for c in fold.inputs]
        self.made = Row(*rows.names, *(f.name for f in fold.outputs), LATE)
        self.nothing = [None] * len(fold.outputs)

    def init(self, handle):
        self.handle, self.served = handle, set()
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getValueState("states", "states binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        now, new, first, out, at = timerValues.getCurrentWatermarkInMs(), [], None, [], None
        for row in rows:
            at = at or [row.__fields__.index(name) for name in self.rows.names]
            plain = tuple(row)
            values = tuple([plain[i] for i in at])
            time = values[self.at]
            if time is None or time < now:
                out.append(self.made(*values, *self.nothing, time is not None))
                continue
            new.append(values)
            first = time if first is None or time < first else first
            if len(new) == _CHUNK:
                self.waiting.appendValue((pickle.dumps(new),))
                new = []
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if key in self.served:  # all that is due in a micro-batch is due at its first timer
            return iter(())
        self.served.add(key)
        now, due, rest = timerValues.getCurrentWatermarkInMs(), {}, []
        for (chunk,) in self.waiting.get():
            for row in pickle.loads(chunk):
                if row[self.at] < now:
                    due.setdefault(tuple([row[i] for i in self.key]), []).append(row)
                else:
                    rest.append(row)
        if due and rest:
            self.waiting.put([(pickle.dumps(rest[n : n + _CHUNK]),) for n in range(0, len(rest), _CHUNK)])
            self.handle.registerTimer(min(row[self.at] for row in rest) + 1)
        elif due:
            self.waiting.clear()
        return iter(self._fold(due, now))

    def _fold(self, due: dict[tuple, list[tuple]], now: int) -> list[Row]:
        """The rows of each key, in order, with what the fold makes of them; states are kept with the time they go stale."""
        held, made = self.states.get(), []
        states = pickle.loads(held[0]) if held else {}
        for key, rows in due.items():
            state = self.fold.load(states[key][0]) if key in states else self.fold.fresh()
            for row in sorted(rows, key=lambda r: tuple([r[i] for i in self.place])):
                made.append(self.made(*row, *self.fold.step(state, *[row[i] for i in self.inputs]), False))
            states[key] = self.fold.dump(state), self.fold.stale_at(state)
        # what still waits is not earlier than now
        kept = {key: state for key, state in states.items() if state[1] is None or state[1] >= now}
        if kept and (due or len(kept) < len(states)):
            self.states.update((pickle.dumps(kept),))
        elif held and not kept:
            self.states.clear()
        ends = [stale for _, stale in kept.values() if stale is not None]
        if ends:
            self.handle.registerTimer(max(ends) + 1)
        return made

    def close(self):
        pass


def keyed_fold_stream(
    df: DataFrame, keys: Sequence[str], ts_ms: str, tie: Sequence[str], fold: Fold, delay: str
) -> DataFrame:
    """Streaming ``keyed_fold``: ``df`` (scalar columns) plus the columns of ``fold`` and ``late``.

    The watermark is taken on a column that the stateful step does not get: Spark drops late rows only where it sees
    that column, so they reach the step, which knows the watermark and tells them apart. State is grouped by buckets of
    keys (``_FoldProcessor``).
    """
    use_rocksdb(df.sparkSession)
    rows = df.schema
    out = T.StructType([*rows.fields, *fold.outputs, T.StructField(LATE, T.BooleanType())])
    timed = df.withColumn(EVENT_TIME, F.timestamp_millis(ts_ms)).withWatermark(EVENT_TIME, delay).drop(EVENT_TIME)
    processor = _FoldProcessor(fold, list(keys), ts_ms, [ts_ms, *tie], rows)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    return timed.withColumn(_BUCKET, bucket).groupBy(_BUCKET).transformWithState(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def _on_time(out: DataFrame, keep_late: bool) -> DataFrame:
    return out if keep_late else out.filter(~F.col(LATE)).drop(LATE)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sliding_window_allow_stream(
    df: DataFrame, key, ts_ms: str, tie, limit: int, window_ms: int, kind: str | None = None, delay: str = "10 minutes",
    keep_late: bool = False,
) -> DataFrame:
    """``sliding_window_allow`` on a stream. ``keep_late`` keeps late rows, with nulls and ``late``."""
    out = keyed_fold_stream(df, _keys(key), ts_ms, _keys(tie), SlidingWindow(ts_ms, kind, limit, window_ms), delay)
    return _on_time(out, keep_late)


def token_bucket_stream(
    df: DataFrame, key, ts_ms: str, tie, rate_per_sec: float, burst: float, cost=1, kind: str | None = None,
    delay: str = "10 minutes", keep_late: bool = False,
) -> DataFrame:
    flat, column = (0.0, cost) if isinstance(cost, str) else (cost, None)
    fold = TokenBucket(ts_ms, kind, column, rate_per_sec, burst, flat)
    return _on_time(keyed_fold_stream(df, _keys(key), ts_ms, _keys(tie), fold, delay), keep_late)


def suppress_repeats_stream(
    df: DataFrame, key, text: str, ts_ms: str, tie, gap_ms: int = REPEAT_GAP_MS, delay: str = "10 minutes"
) -> DataFrame:
    out = keyed_fold_stream(df, _keys(key), ts_ms, _keys(tie), Repeats(text, ts_ms, gap_ms), delay)
    return out.filter("emitted").drop("emitted", LATE)


def idle_gaps_stream(
    df: DataFrame, key, ts_ms: str, tie, interval_ms: int = HEARTBEAT_MS, slack_ms: int = HEARTBEAT_SLACK_MS,
    delay: str = "10 minutes",
) -> DataFrame:
    """The row that ends each long silence, with the silence in ``idle_ms``."""
    out = keyed_fold_stream(df, _keys(key), ts_ms, _keys(tie), Idle(ts_ms), delay)
    return out.filter(F.col("idle_ms") >= interval_ms - slack_ms).drop(LATE)


def replay_leases_stream(commands: DataFrame, max_attempts: int = 3, delay: str = "10 minutes") -> DataFrame:
    """Outcome per command; commands of a queue are taken in (now_ms, seq) order."""
    return _on_time(keyed_fold_stream(commands, ["queue_id"], "now_ms", ["seq"], Leases(max_attempts), delay), False)
