"""Operators over activity streams and snapshots."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.fixed_values import HEARTBEAT_MS, HEARTBEAT_SLACK_MS, REPEAT_GAP_MS, UNWATCHED_FILES, UNWATCHED_FOLDERS
from ledgerline.functions.text import strip
from ledgerline.operators.folds import Fold, keyed_fold, pruned_fold
from ledgerline.operators.ordered import MAX_ROWS, ordered


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


class Repeats(Fold):
    """State: the text last emitted and when."""

    outputs = (T.StructField("emitted", T.BooleanType()),)

    def __init__(self, text: str, ts: str, gap_ms: int):
        self.inputs, self.timed, self.gap = (text, ts), 1, gap_ms

    def fresh(self):
        return [None, None]

    def step(self, state, text, now):
        text = (text or "").strip()
        if not text or (text == state[0] and now - state[1] < self.gap):
            return (False,)
        state[:] = text, now
        return (True,)

    def dump(self, state):
        return json.dumps(state)

    def load(self, text):
        return json.loads(text)

    def stale_at(self, state):
        return 0 if state[0] is None else state[1] + self.gap

    def watcher(self):
        """Sure once a text differs from the one before it, or comes a whole gap later."""
        last = [None, None]

        def watch(text, now):
            text = (text or "").strip()
            if not text:
                return False
            sure = last[0] is not None and (text != last[0] or now - last[1] >= self.gap)
            last[:] = text, now
            return sure

        return watch


def mark_repeats(
    df: DataFrame, key, text: str, ts_ms: str, tie, gap_ms: int = REPEAT_GAP_MS,
    state_in: DataFrame | None = None, max_rows: int = MAX_ROWS, prune: bool = False,
) -> DataFrame:
    """Add ``emitted``: false for a blank text, or the text emitted last less than ``gap_ms`` ago.

    ``prune``: only runs of one text that last as long as the gap reach the fold, window functions tell the rest. That is
    worth its sorts where texts change often.
    """
    keys, order, fold = _keys(key), [ts_ms, *_keys(tie)], Repeats(text, ts_ms, gap_ms)
    if not prune or state_in is not None:
        return keyed_fold(df, keys, order, fold, state_in, max_rows)
    return pruned_fold(df, keys, order, fold, lambda rows: told_repeats(rows, keys, order, text, gap_ms), ["_run"], max_rows)


def told_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, gap_ms: int) -> DataFrame:
    """``df`` with ``emitted`` as far as windows can tell, ``_open`` and ``_fed`` where they cannot, and ``_run``.

    A run is a row of equal texts, each less than the gap after the one before, blank rows left aside. Its first row is
    emitted, since the text last emitted is always that of the row before. Rows less than a gap after the first are not.
    So a run is open only if it lasts a gap or longer, and the fold may start afresh on each.
    """
    ts, by = F.col(order[0]), Window.partitionBy(*keys).orderBy(*order)
    plain = strip(text)
    timed = F.coalesce(plain, F.lit("")) != ""
    rows = df.withColumn("_said", F.when(timed & ts.isNotNull(), plain))
    # rows without text or time are passed over: the last said text and its time before a row
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("_said").isNotNull(), F.struct("_said", ts.alias("at"))), ignorenulls=True).over(before)
    rows = rows.withColumn("_before", said)
    again = (F.col("_before._said") == F.col("_said")) & (ts - F.col("_before.at") < gap_ms)
    start = F.col("_said").isNotNull() & ~F.coalesce(again, F.lit(False))
    to_here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_start", start).withColumns({
        "_run": F.sum(F.col("_start").cast("long")).over(to_here), "_first": F.last(F.when(F.col("_start"), ts), ignorenulls=True).over(to_here),
    })
    late = F.col("_said").isNotNull() & (ts - F.col("_first") >= gap_ms)
    lasting = F.max(late).over(Window.partitionBy(*keys, "_run"))
    emitted = F.when(ts.isNotNull(), F.col("_start"))
    told = rows.withColumns({"_open": F.col("_said").isNotNull() & F.coalesce(lasting, F.lit(False)), "emitted": emitted})
    return told.withColumn("_fed", F.col("_open")).drop("_said", "_before", "_start", "_first")


def suppress_repeats(
    df: DataFrame, key, text: str, ts_ms: str, tie, gap_ms: int = REPEAT_GAP_MS,
    state_in: DataFrame | None = None, max_rows: int = MAX_ROWS, prune: bool = False,
) -> DataFrame:
    """Only the rows that ``mark_repeats`` emits."""
    return mark_repeats(df, key, text, ts_ms, tie, gap_ms, state_in, max_rows, prune).filter("emitted").drop("emitted")


class Idle(Fold):
    """State: the time of the row before."""

    outputs = (T.StructField("idle_ms", T.LongType()),)

    def __init__(self, ts: str):
        self.inputs, self.timed = (ts,), 0

    def fresh(self):
        return [None]

    def step(self, state, now):
        idle = None if state[0] is None else now - state[0]
        state[0] = now
        return (idle,)

    def dump(self, state):
        return json.dumps(state)

    def load(self, text):
        return json.loads(text)


def watched(snapshot: DataFrame, path: str = "path") -> DataFrame:
    """Files of a snapshot that count as activity."""
    parts = F.split(path, "/")
    ignored = F.arrays_overlap(parts, F.array(*map(F.lit, UNWATCHED_FOLDERS)))
    return snapshot.filter(~ignored & ~F.element_at(parts, -1).isin(UNWATCHED_FILES))


def snapshot_diff(prev: DataFrame, curr: DataFrame, key, cols: Sequence[str]) -> DataFrame:
    """``(key…, change)``: ``wrote`` for a new or changed row, ``removed`` for one that is gone."""
    keys = _keys(key)
    p = prev.select(*keys, F.struct(*cols).alias("_before"))
    c = curr.select(*keys, F.struct(*cols).alias("_after"))
    change = F.when(F.col("_after").isNull(), "removed").when(~F.col("_before").eqNullSafe(F.col("_after")), "wrote")
    return p.join(c, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")


def idle_gaps(
    df: DataFrame, key, ts_ms: str, tie, interval_ms: int = HEARTBEAT_MS, slack_ms: int = HEARTBEAT_SLACK_MS,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Silences of at least ``interval_ms - slack_ms``: the row before each, with ``next_ms`` and ``idle_ms``."""
    rows = ordered(df, _keys(key), [ts_ms, *_keys(tie)], max_rows).lead("next_ms", F.col(ts_ms)).rows()
    return rows.withColumn("idle_ms", F.col("next_ms") - F.col(ts_ms)).filter(F.col("idle_ms") >= interval_ms - slack_ms)


def no_progress(
    df: DataFrame, key, order: Sequence[str], signature: Sequence[str], max_rows: int = MAX_ROWS
) -> DataFrame:
    """Add ``reset``: the attempt repeats the signature before it, and that one was not itself a reset.

    In a run of equal signatures every second row resets, since a reset forgets the signature.
    """
    sig = F.struct(*signature)
    o = ordered(df, _keys(key), list(order), max_rows).lag("_before", sig).running_sum("_nth", F.lit(1))
    starts = F.when(~F.col("_before").eqNullSafe(sig), F.col("_nth"))
    o = o.running_max("_start", starts)
    return o.rows().withColumn("reset", (F.col("_nth") - F.col("_start")) % 2 == 1).drop("_before", "_nth", "_start")


