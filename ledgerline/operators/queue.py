"""Replay of lease-queue command logs.

``commands(queue_id, seq, now_ms, op, msg_id, delay_ms, visibility_ms, lease_ref)``, in ``seq``
order per queue. ``op``: ``enqueue``, ``lease``, ``ack``, ``nack`` or ``count``. A lease is known
by the ``seq`` of the command that took it, and ``ack``/``nack`` name it in ``lease_ref``; they may
leave ``msg_id`` null to mean whatever message that lease holds.
"""

from __future__ import annotations

import json
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.folds import Fold, final_states, keyed_fold
from ledgerline.operators.ordered import MAX_ROWS

KEYS, ORDER = ["queue_id"], ["seq"]
ITEM = "struct<msg_id:string,attempts:long,available_at:long,lease_ref:long,lease_until:long,dead:boolean>"


class _Queue:
    """Messages by id, with heaps over the ready and the leased ones (entries may be stale), and the
    message of each active lease."""

    def __init__(self):
        self.items, self.ready, self.leases, self.held = {}, [], [], {}


class Leases(Fold):
    inputs = ("op", "now_ms", "seq", "msg_id", "delay_ms", "visibility_ms", "lease_ref")
    outputs = (
        T.StructField("done", T.BooleanType()),
        T.StructField("out_msg", T.StringType()),
        T.StructField("out_attempts", T.LongType()),
        T.StructField("ready", T.LongType()),
        T.StructField("leased", T.LongType()),
        T.StructField("dead", T.LongType()),
    )

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def fresh(self):
        return _Queue()

    def _fail(self, q, item, now):
        """An attempt ended without success: count it, and ready the message or bury it."""
        q.held.pop(item["lease_ref"], None)
        item.update(lease_ref=None, lease_until=0, available_at=now, attempts=item["attempts"] + 1)
        item["dead"] = item["attempts"] >= self.max_attempts
        if not item["dead"]:
            heappush(q.ready, (now, item["msg_id"]))

    def _expire(self, q, now):
        while q.leases and q.leases[0][0] <= now:
            _, msg, ref = heappop(q.leases)
            item = q.items.get(msg)
            if item and item["lease_ref"] == ref:
                self._fail(q, item, now)

    def _next_ready(self, q, now):
        while q.ready and q.ready[0][0] <= now:
            at, msg = heappop(q.ready)
            item = q.items.get(msg)
            if item and not item["dead"] and item["lease_ref"] is None and item["available_at"] == at:
                return item
        return None

    def step(self, q, op, now, seq, msg, delay, visibility, ref):
        if op == "enqueue":
            at = now + max(0, delay or 0)
            q.items[msg] = dict(msg_id=msg, attempts=0, available_at=at, lease_ref=None, lease_until=0, dead=False)
            heappush(q.ready, (at, msg))
            return True, msg, 0, None, None, None
        self._expire(q, now)
        if op == "lease":
            item = self._next_ready(q, now)
            if item is None:
                return False, None, None, None, None, None
            item.update(lease_ref=seq, lease_until=now + max(1, visibility or 0))
            heappush(q.leases, (item["lease_until"], item["msg_id"], seq))
            q.held[seq] = item["msg_id"]
            return True, item["msg_id"], item["attempts"], None, None, None
        if op == "count":
            live = [i for i in q.items.values() if not i["dead"]]
            leased = sum(i["lease_ref"] is not None for i in live)
            ready = sum(i["lease_ref"] is None and i["available_at"] <= now for i in live)
            return True, None, None, ready, leased, len(q.items) - len(live)
        held = ref is not None and ref in q.held and msg in (None, q.held[ref])
        msg = q.held[ref] if held else msg
        item = q.items.get(msg)
        if held and op == "ack":
            del q.items[msg], q.held[ref]
        elif held and op == "nack":
            self._fail(q, item, now)
        return held, msg, item["attempts"] if held else None, None, None, None

    def dump(self, q):
        return json.dumps(list(q.items.values()))

    def load(self, text):
        q = _Queue()
        for item in json.loads(text):
            q.items[item["msg_id"]] = item
            if item["lease_ref"] is not None:
                heappush(q.leases, (item["lease_until"], item["msg_id"], item["lease_ref"]))
                q.held[item["lease_ref"]] = item["msg_id"]
            elif not item["dead"]:
                heappush(q.ready, (item["available_at"], item["msg_id"]))
        return q


def replay_outcomes(
    commands: DataFrame, max_attempts: int = 3, state_in: DataFrame | None = None, max_rows: int = MAX_ROWS
) -> DataFrame:
    """The commands with what came of each: ``done``, the message and its attempts, or the counts."""
    return keyed_fold(commands, KEYS, ORDER, Leases(max_attempts), state_in, max_rows)


def replay_state(
    commands: DataFrame, max_attempts: int = 3, state_in: DataFrame | None = None, max_rows: int = MAX_ROWS
) -> DataFrame:
    """``(queue_id, state)`` after the last command; the ``state_in`` of a later replay."""
    return final_states(commands, KEYS, ORDER, Leases(max_attempts), state_in, max_rows)


def queue_items(state: DataFrame) -> DataFrame:
    """One row per message still in a queue."""
    return state.select("queue_id", F.inline(F.from_json("state", f"array<{ITEM}>")))


def replay_leases(commands: DataFrame, max_attempts: int = 3, max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """Outcomes of all commands, and the messages left at the end."""
    return (
        replay_outcomes(commands, max_attempts, None, max_rows),
        queue_items(replay_state(commands, max_attempts, None, max_rows)),
    )


def queue_depth(items: DataFrame, as_of_ms: Column | int, max_attempts: int = 3) -> DataFrame:
    """Ready, leased and dead messages per queue at a moment, leases that ran out by then included."""
    now = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    held = F.col("lease_ref").isNotNull() & (F.col("lease_until") > now)
    lapsed = F.col("lease_ref").isNotNull() & (F.col("lease_until") <= now)
    dead = F.col("dead") | (lapsed & (F.col("attempts") + 1 >= max_attempts))
    ready = ~dead & (lapsed | (F.col("lease_ref").isNull() & (F.col("available_at") <= now)))
    return items.groupBy("queue_id").agg(
        F.count_if(ready).alias("ready"), F.count_if(held).alias("leased"), F.count_if(dead).alias("dead")
    )


def queue_dead_letters(items: DataFrame) -> DataFrame:
    return items.filter("dead").select("queue_id", "msg_id", "attempts")
