"""Rate limiting over ``events``: one limiter per user, in (time, event id) order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators.ratelimit import (
    sliding_window_allow,
    sliding_window_remaining,
    sliding_window_state,
    token_bucket,
    token_bucket_state,
)
from ledgerline.plans.registry import events, query

DAY_MS = 86_400_000
LIMIT, WINDOW_MS = 5, 2 * DAY_MS
RATE, BURST = 2 / 86_400, 3
KEY = dict(key="user_id", ts_ms="ts_ms", tie="event_id")

_CALLS = """
calls AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ts_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn
  FROM events)"""

# hits: admitted times still inside the window, before the row's own decision.
_WINDOW_SQL = f"""
WITH RECURSIVE {_CALLS},
walk AS (
  SELECT event_id, user_id, rn, ts_ms, true AS allowed, [ts_ms] AS hits FROM calls WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, rn, ts_ms, len(live) < {LIMIT},
         CASE WHEN len(live) < {LIMIT} THEN list_append(live, ts_ms) ELSE live END
  FROM (SELECT c.event_id, c.user_id, c.rn, c.ts_ms,
               list_filter(w.hits, lambda h: h > c.ts_ms - {WINDOW_MS}) AS live
        FROM walk w JOIN calls c ON c.user_id = w.user_id AND c.rn = w.rn + 1))"""

_BUCKET_STEP = f"least({BURST}.0, tokens + greatest(0, ts_ms - last_ms) / 1000.0::DOUBLE * {RATE!r}::DOUBLE)"


def _bucket_sql(cost: str, reset: str) -> str:
    """Walk of (tokens, last_ms); a null last_ms is a bucket nobody has touched."""
    return f"""
WITH RECURSIVE {_CALLS},
priced AS (SELECT *, ({cost})::DOUBLE AS cost, ({reset}) AS is_reset FROM calls),
walk AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, {BURST}::DOUBLE AS tokens, NULL::BIGINT AS last_ms,
         NULL::BOOLEAN AS allowed
  FROM (SELECT DISTINCT user_id FROM calls)
  UNION ALL
  SELECT user_id, rn, event_id,
         CASE WHEN is_reset THEN {BURST}::DOUBLE WHEN level >= cost THEN level - cost ELSE level END,
         CASE WHEN is_reset THEN NULL ELSE ts_ms END,
         CASE WHEN is_reset THEN NULL ELSE level >= cost END
  FROM (SELECT *, CASE WHEN last_ms IS NULL THEN {BURST}::DOUBLE ELSE {_BUCKET_STEP} END AS level
        FROM (SELECT p.*, w.tokens, w.last_ms FROM walk w
              JOIN priced p ON p.user_id = w.user_id AND p.rn = w.rn + 1)))"""


_FLAT_BUCKET = _bucket_sql("1", "false")


def _bucket(spark, sf_dir, **more):
    return token_bucket(events(spark, sf_dir).select("event_id", "user_id", "ts_ms"), **KEY,
                        rate_per_sec=RATE, burst=BURST, **more)


@query("token_bucket", _FLAT_BUCKET + "SELECT event_id, user_id, allowed, tokens FROM walk WHERE rn > 0")
def bucket_rows(spark, sf_dir):
    return _bucket(spark, sf_dir).select("event_id", "user_id", "allowed", "tokens")


@query(
    "token_bucket_by_user",
    _FLAT_BUCKET + """
SELECT user_id, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS denied
FROM walk WHERE rn > 0 GROUP BY user_id""",
)
def bucket_by_user(spark, sf_dir):
    return _bucket(spark, sf_dir).groupBy("user_id").agg(
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied")
    )


@query(
    "token_bucket_cost_and_reset",
    _bucket_sql("CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END", "event_type = 'error'")
    + "SELECT event_id, allowed, tokens FROM walk WHERE rn > 0",
)
def bucket_cost_and_reset(spark, sf_dir):
    """Purchases cost two tokens; an error clears the user's bucket."""
    calls = events(spark, sf_dir).select(
        "event_id", "user_id", "ts_ms",
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("cost"),
        F.when(F.col("event_type") == "error", "reset").otherwise("call").alias("kind"),
    )
    out = token_bucket(calls, **KEY, rate_per_sec=RATE, burst=BURST, cost="cost", kind="kind")
    return out.select("event_id", "allowed", "tokens")


@query(
    "sliding_window_allow",
    _WINDOW_SQL + f"SELECT event_id, user_id, allowed, ({LIMIT} - len(hits))::BIGINT AS remaining FROM walk",
)
def window_rows(spark, sf_dir):
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    return sliding_window_allow(calls, **KEY, limit=LIMIT, window_ms=WINDOW_MS).drop("ts_ms")


@query(
    "sliding_window_remaining",
    # A probe is stamped one window-third after its event; it sees the hits of the last event not after it.
    _WINDOW_SQL + f"""
, probes AS (SELECT event_id, user_id, ts_ms + {WINDOW_MS // 3} AS at FROM calls)
SELECT p.event_id, p.user_id,
       ({LIMIT} - len(list_filter(w.hits, lambda h: h > p.at - {WINDOW_MS})))::BIGINT AS remaining
FROM probes p ASOF JOIN walk w ON p.user_id = w.user_id AND p.at >= w.ts_ms""",
)
def window_remaining(spark, sf_dir):
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    probes = calls.withColumn("ts_ms", F.col("ts_ms") + WINDOW_MS // 3)
    return sliding_window_remaining(calls, probes, **KEY, limit=LIMIT, window_ms=WINDOW_MS).drop("ts_ms")


@query(
    "sliding_window_hot_key",
    _WINDOW_SQL.replace("user_id", "event_type").replace("event_id, event_type, event_type,", "event_id, event_type,")
    + f"SELECT event_id, event_type, allowed, ({LIMIT} - len(hits))::BIGINT AS remaining FROM walk",
)
def window_hot(spark, sf_dir):
    """One limiter per event type, each too large for one task and never at rest."""
    calls = events(spark, sf_dir).select("event_id", "event_type", "ts_ms")
    key = KEY | {"key": "event_type"}
    return sliding_window_allow(calls, **key, limit=LIMIT, window_ms=WINDOW_MS, max_rows=calls.count() // 8).drop("ts_ms")


def _halves(spark, sf_dir):
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    noon = calls.agg(F.floor((F.min("ts_ms") + F.max("ts_ms")) / 2)).first()[0]
    return calls.filter(F.col("ts_ms") < noon), calls.filter(F.col("ts_ms") >= noon)


@query(
    "limiter_state_carried",
    f"""
WITH w AS ({_WINDOW_SQL} SELECT event_id, allowed AS window_allowed FROM walk),
b AS ({_FLAT_BUCKET} SELECT event_id, allowed AS bucket_allowed FROM walk WHERE rn > 0),
m AS (SELECT (min(epoch_us(ts) // 1000) + max(epoch_us(ts) // 1000)) // 2 AS noon FROM events)
SELECT event_id, window_allowed, bucket_allowed FROM w JOIN b USING (event_id) JOIN events e USING (event_id), m
WHERE epoch_us(e.ts) // 1000 >= noon""",
)
def state_carried(spark, sf_dir):
    """The second half of the events, continued from the states the first half left."""
    first, second = _halves(spark, sf_dir)
    window = dict(**KEY, limit=LIMIT, window_ms=WINDOW_MS)
    bucket = dict(**KEY, rate_per_sec=RATE, burst=BURST)
    w = sliding_window_allow(second, **window, state_in=sliding_window_state(first, **window))
    b = token_bucket(second, **bucket, state_in=token_bucket_state(first, **bucket))
    return w.select("event_id", F.col("allowed").alias("window_allowed")).join(
        b.select("event_id", F.col("allowed").alias("bucket_allowed")), "event_id"
    )


@query(
    "window_without_times",
    "SELECT event_id, user_id, event_type = 'view' AS untimed FROM events",
)
def untimed(spark, sf_dir):
    """Calls without a time are neither admitted nor denied, and end nothing."""
    calls = events(spark, sf_dir).select("event_id", "user_id", F.when(F.col("event_type") != "view", F.col("ts_ms")).alias("ts_ms"))
    out = sliding_window_allow(calls, **KEY, limit=LIMIT, window_ms=WINDOW_MS)
    return out.select("event_id", "user_id", (F.col("allowed").isNull() & F.col("remaining").isNull()).alias("untimed"))


@query(
    "sliding_window_reset",
    f"""
WITH RECURSIVE {_CALLS},
walk AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, []::BIGINT[] AS hits, NULL::BOOLEAN AS allowed
  FROM (SELECT DISTINCT user_id FROM calls)
  UNION ALL
  SELECT user_id, rn, event_id,
         CASE WHEN is_reset THEN []::BIGINT[] WHEN len(live) < {LIMIT} THEN list_append(live, ts_ms) ELSE live END,
         CASE WHEN is_reset THEN NULL ELSE len(live) < {LIMIT} END
  FROM (SELECT c.*, event_type = 'error' AS is_reset, list_filter(w.hits, lambda h: h > c.ts_ms - {WINDOW_MS}) AS live
        FROM walk w JOIN calls c ON c.user_id = w.user_id AND c.rn = w.rn + 1))
SELECT event_id, allowed, ({LIMIT} - len(hits))::BIGINT AS remaining FROM walk WHERE rn > 0""",
)
def window_reset(spark, sf_dir):
    """An error clears the user's window."""
    kind = F.when(F.col("event_type") == "error", "reset").otherwise("call").alias("kind")
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts_ms", kind)
    return sliding_window_allow(calls, **KEY, limit=LIMIT, window_ms=WINDOW_MS, kind="kind").select("event_id", "allowed", "remaining")


@query(
    "sliding_window_pruned",
    _WINDOW_SQL + f"SELECT event_id, allowed, ({LIMIT} - len(hits))::BIGINT AS remaining FROM walk",
)
def window_pruned(spark, sf_dir):
    """The same admissions, with the calls that window functions can tell kept from the fold."""
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    out = sliding_window_allow(calls, **KEY, limit=LIMIT, window_ms=WINDOW_MS, prune=True)
    return out.select("event_id", "allowed", "remaining")
