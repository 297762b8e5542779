"""Rate limiting over a table of calls, in order per key.

Two limiters with separate state. Rows may carry a ``kind``: ``call`` (the default) asks for
admission, ``remaining`` (sliding window only) asks how many calls would be admitted and records
nothing, ``reset`` clears the key.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.folds import Fold, final_states, keyed_fold, pruned_fold
from ledgerline.operators.ordered import MAX_ROWS

#: A larger limit is left to the fold: every call would look back over so many others.
MOST_LAGS = 64


class SlidingWindow(Fold):
    """Admit while fewer than ``limit`` admitted calls lie in ``(now - window_ms, now]``."""

    outputs = (T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType()))

    def __init__(self, ts: str, kind: str | None, limit: int, window_ms: int):
        self.inputs, self.timed = ((ts, kind) if kind else (ts,)), 0
        self.limit, self.window = int(limit), int(window_ms)

    def fresh(self):
        return deque()

    def step(self, hits, now, kind="call"):
        if kind == "reset":
            hits.clear()
            return None, self.limit
        while hits and hits[0] <= now - self.window:
            hits.popleft()
        allowed = None
        if kind == "call":
            allowed = len(hits) < self.limit
            if allowed:
                hits.append(now)
        return allowed, max(0, self.limit - len(hits))

    def dump(self, hits):
        return json.dumps(list(hits))

    def load(self, text):
        return deque(json.loads(text))

    def stale_at(self, hits):
        return hits[-1] + self.window if hits else 0

    def watcher(self):
        """Sure after a reset, a silent window, or a window in which every call was sure to pass.

        A call is sure to pass when at most ``limit`` calls were offered in its window, all of them
        seen. Once a whole window holds such calls only, the state is exactly those calls.
        """
        offered, marks = deque(), {"start": None, "doubt": None, "last": None}

        def watch(now, kind="call"):
            if kind == "reset":
                return True
            if kind != "call":
                return False
            if marks["last"] is not None and now - marks["last"] >= self.window:
                return True
            marks["last"] = now
            if marks["start"] is None:
                marks["start"] = marks["doubt"] = now
            offered.append(now)
            while offered[0] <= now - self.window:
                offered.popleft()
            if len(offered) > self.limit or now - self.window < marks["start"]:
                marks["doubt"] = now
            return marks["doubt"] <= now - self.window

        return watch


class TokenBucket(Fold):
    """A bucket that starts full, refills with time up to ``burst`` and pays ``cost`` per call."""

    outputs = (T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType()))

    def __init__(self, ts: str, kind: str | None, cost: str | None, rate_per_sec: float, burst: float, flat: float):
        self.inputs, self.timed = tuple(c for c in (ts, kind, cost) if c), 0
        self.has_kind, self.has_cost = kind is not None, cost is not None
        self.rate, self.cap, self.flat = float(rate_per_sec), float(burst), float(flat)

    def _read(self, rest):
        kind = rest[0] if self.has_kind else "call"
        return kind, float(rest[-1]) if self.has_cost else self.flat

    def fresh(self):
        return [None, None]

    def step(self, state, now, *rest):
        kind, cost = self._read(rest)
        if kind == "reset":
            state[:] = None, None
            return None, self.cap
        tokens, last = state if state[1] is not None else (self.cap, now)
        # The order of these operations fixes the rounding of every later level.
        tokens = min(self.cap, tokens + max(0, now - last) / 1000.0 * self.rate)
        allowed = tokens >= cost
        state[:] = (tokens - cost if allowed else tokens), now
        return allowed, state[0]

    def dump(self, state):
        return json.dumps(state)

    def load(self, text):
        return json.loads(text)

    def stale_at(self, state):
        """A bucket that has filled up again is as good as new."""
        tokens, last = state
        if last is None:
            return 0
        if self.rate <= 0:
            return None
        wait = max(0, math.ceil((self.cap - tokens) / self.rate * 1000.0))
        return last + wait + (tokens + wait / 1000.0 * self.rate < self.cap)

    def watcher(self):
        """Sure after a reset, or a pause long enough to fill an empty bucket."""
        last = [None]

        def watch(now, *rest):
            kind, _ = self._read(rest)
            full = last[0] is not None and max(0, now - last[0]) / 1000.0 * self.rate >= self.cap
            last[0] = now
            return kind == "reset" or full

        return watch


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _order(ts_ms, tie) -> list[str]:
    return [ts_ms, *_keys(tie)]


def sliding_window_allow(
    df: DataFrame, key, ts_ms: str, tie, limit: int, window_ms: int,
    kind: str | None = None, state_in: DataFrame | None = None, max_rows: int = MAX_ROWS, prune: bool = False,
) -> DataFrame:
    """Add ``allowed`` (null on non-call rows) and ``remaining`` after the row. Rows without a time get nulls.

    ``prune``: of plain calls only those within a window of one that window functions cannot tell reach the fold. That
    is worth its two sorts where few calls are near their limit.
    """
    fold, keys, order = SlidingWindow(ts_ms, kind, limit, window_ms), _keys(key), _order(ts_ms, tie)
    if not prune or kind is not None or state_in is not None or not 0 < limit <= MOST_LAGS:
        return keyed_fold(df, keys, order, fold, state_in, max_rows)
    return pruned_fold(df, keys, order, fold, lambda rows: told_calls(rows, keys, order, limit, window_ms), (), max_rows)


def told_calls(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, window_ms: int) -> DataFrame:
    """``df`` with ``allowed`` and ``remaining`` as far as windows can tell, ``_open`` where they cannot, and ``_fed``.

    A call is sure to pass if the ``limit``-th call before it, passed or not, lies outside its window. What a call leaves
    is sure too if all calls in its window are, for then these are the calls that passed. So only calls with an unsure
    one less than a window before them, or unsure themselves, are open; their answers depend on those and on the calls
    less than a window before an unsure one.
    """
    ts = F.col(order[0])
    by = Window.partitionBy(*keys, ts.isNull()).orderBy(*order)  # rows without a time are apart
    back = Window.partitionBy(*keys, ts.isNull()).orderBy(*[F.col(c).desc() for c in order])
    lags = [F.lag(ts, n).over(by) for n in range(1, limit + 1)]
    rows = df.withColumn("_lags", F.array(*lags))
    unsure = F.col("_lags")[limit - 1] > ts - window_ms
    rows = rows.withColumn("_unsure", F.when(F.coalesce(unsure, F.lit(False)), ts))
    first_to_here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_last", F.max("_unsure").over(first_to_here))
    rows = rows.withColumn("_next", F.min("_unsure").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    after, ahead = (F.coalesce(gap < window_ms, F.lit(False)) for gap in (ts - F.col("_last"), F.col("_next") - ts))
    inside = F.size(F.filter("_lags", lambda at: at > ts - window_ms))
    return rows.withColumns({
        "_open": after, "_fed": after | ahead, "allowed": F.when(ts.isNotNull(), True),
        "remaining": F.when(ts.isNotNull(), F.greatest(F.lit(0), F.lit(limit) - 1 - inside)).cast("long"),
    }).drop("_lags", "_unsure", "_last", "_next")


def sliding_window_remaining(
    calls: DataFrame, probes: DataFrame, key, ts_ms: str, tie, limit: int, window_ms: int, max_rows: int = MAX_ROWS
) -> DataFrame:
    """For each row of ``probes``: how many calls would be admitted at that moment."""
    both = calls.select(*_keys(key), *_order(ts_ms, tie), F.lit("call").alias("_kind")).unionByName(
        probes.select(*_keys(key), *_order(ts_ms, tie), F.lit("remaining").alias("_kind"))
    )
    out = sliding_window_allow(both, key, ts_ms, [*_keys(tie), "_kind"], limit, window_ms, "_kind", None, max_rows)
    return out.filter("_kind = 'remaining'").drop("_kind", "allowed")


def token_bucket(
    df: DataFrame, key, ts_ms: str, tie, rate_per_sec: float, burst: float, cost=1,
    kind: str | None = None, state_in: DataFrame | None = None, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add ``allowed`` (null on reset rows) and the ``tokens`` left. ``cost``: a number or a column name.

    Rows without a time get nulls and change nothing.
    """
    flat, column = (0.0, cost) if isinstance(cost, str) else (cost, None)
    fold = TokenBucket(ts_ms, kind, column, rate_per_sec, burst, flat)
    return keyed_fold(df, _keys(key), _order(ts_ms, tie), fold, state_in, max_rows)


def sliding_window_state(
    df: DataFrame, key, ts_ms: str, tie, limit: int, window_ms: int,
    kind: str | None = None, state_in: DataFrame | None = None, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """State per key after the last row; feed it to ``state_in`` of a later run."""
    fold = SlidingWindow(ts_ms, kind, limit, window_ms)
    return final_states(df, _keys(key), _order(ts_ms, tie), fold, state_in, max_rows)


def token_bucket_state(
    df: DataFrame, key, ts_ms: str, tie, rate_per_sec: float, burst: float, cost=1,
    kind: str | None = None, state_in: DataFrame | None = None, max_rows: int = MAX_ROWS,
) -> DataFrame:
    flat, column = (0.0, cost) if isinstance(cost, str) else (cost, None)
    fold = TokenBucket(ts_ms, kind, column, rate_per_sec, burst, flat)
    return final_states(df, _keys(key), _order(ts_ms, tie), fold, state_in, max_rows)
