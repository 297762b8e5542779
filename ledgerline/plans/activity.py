"""Activity streams, snapshots and attempts over ``events``, ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators.activity import idle_gaps, no_progress, snapshot_diff, suppress_repeats, watched
from ledgerline.operators.scoring import attempts_run, attempts_to_pass, latest_attempt
from ledgerline.plans.registry import ORACLES, events, query, table

GAP_MS = 2 * 86_400_000
IDLE_MS = 86_400_000


@query(
    "suppress_repeats",
    f"""
WITH RECURSIVE seen AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ts_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
walk AS (
  SELECT event_id, user_id, rn, true AS emitted, event_type AS last_text, ts_ms AS last_ms FROM seen WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, rn, NOT quiet, CASE WHEN quiet THEN last_text ELSE event_type END,
         CASE WHEN quiet THEN last_ms ELSE ts_ms END
  FROM (SELECT s.*, w.last_text, w.last_ms, s.event_type = w.last_text AND s.ts_ms - w.last_ms < {GAP_MS} AS quiet
        FROM walk w JOIN seen s ON s.user_id = w.user_id AND s.rn = w.rn + 1))
SELECT event_id, user_id FROM walk WHERE emitted""",
)
def repeats(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts_ms")
    return suppress_repeats(rows, "user_id", "event_type", "ts_ms", "event_id", GAP_MS).select("event_id", "user_id")


_SHIPPED = """(SELECT l_partkey AS part, max(l_shipdate) AS changed, count(*) AS size FROM lineitem
 WHERE l_shipdate {0} TIMESTAMP '1997-01-01' GROUP BY l_partkey)"""


@query(
    "snapshot_diff",
    f"""
SELECT coalesce(p.part, c.part) AS part,
       CASE WHEN c.part IS NULL THEN 'removed' ELSE 'wrote' END AS change
FROM {_SHIPPED.format('<')} p FULL JOIN {_SHIPPED.format('>=')} c ON p.part = c.part
WHERE c.part IS NULL OR p.part IS NULL OR p.changed <> c.changed OR p.size <> c.size""",
)
def parts_shipped(spark, sf_dir):
    """Snapshots of the parts shipped before a day and from it on, with their last shipment and how many there were."""
    day, shipped = F.lit("1997-01-01").cast("timestamp_ntz"), table(spark, sf_dir, "lineitem")

    def snapshot(rows):
        return rows.groupBy(F.col("l_partkey").alias("part")).agg(
            F.max("l_shipdate").alias("changed"), F.count(F.lit(1)).alias("size")
        )

    before, since = shipped.filter(F.col("l_shipdate") < day), shipped.filter(F.col("l_shipdate") >= day)
    return snapshot_diff(snapshot(before), snapshot(since), "part", ["changed", "size"])


@query(
    "idle_gaps",
    f"""
SELECT * FROM (
  SELECT user_id, event_id, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) - ms AS idle_ms
  FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events))
WHERE idle_ms >= {IDLE_MS} - 500""",
)
def gaps(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts_ms")
    return idle_gaps(rows, "user_id", "ts_ms", "event_id", IDLE_MS).select("user_id", "event_id", "idle_ms")


@query(
    "no_progress",
    """
WITH steps AS (
  SELECT event_id, user_id, event_type, ts, event_type IS DISTINCT FROM lag(event_type) OVER w AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM steps)
SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) % 2 = 0 AS reset FROM runs""",
)
def resets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return no_progress(rows, "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "reset")


def _quarter_hot(rows):
    """A bound on rows per task that the keys of ``rows``, each holding a fifth of them, exceed."""
    return rows.count() // 8


@query(
    "idle_gaps_hot_key",
    """
SELECT * FROM (
  SELECT event_type, event_id, lead(ms) OVER (PARTITION BY event_type ORDER BY ms, event_id) - ms AS idle_ms
  FROM (SELECT event_type, event_id, epoch_us(ts) // 1000 AS ms FROM events))
WHERE idle_ms >= 600000 - 500""",
)
def gaps_hot(spark, sf_dir):
    """Keys too large for one task each: the windows run over chunks with carries."""
    rows = events(spark, sf_dir).select("event_type", "event_id", "ts_ms")
    out = idle_gaps(rows, "event_type", "ts_ms", "event_id", 600_000, max_rows=_quarter_hot(rows))
    return out.select("event_type", "event_id", "idle_ms")


@query(
    "no_progress_hot_key",
    """
WITH steps AS (
  SELECT event_id, event_type, ts, value > 10 AS sig, (value > 10) IS DISTINCT FROM lag(value > 10) OVER w AS fresh
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM steps)
SELECT event_id, row_number() OVER (PARTITION BY event_type, run ORDER BY ts, event_id) % 2 = 0 AS reset FROM runs""",
)
def resets_hot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.col("value") > 10).alias("sig"))
    out = no_progress(rows, "event_type", ["ts", "event_id"], ["sig"], max_rows=_quarter_hot(rows))
    return out.select("event_id", "reset")


def _attempts(spark, sf_dir):
    """An order is a task, its line numbers are attempts; a returned line is a pass."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("passed")
    )


_ENDS = """
SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R'), max(l_linenumber)) AS attempts,
       bool_or(l_returnflag = 'R') AS passed FROM lineitem {where} GROUP BY l_orderkey"""


@query("attempts_to_pass", _ENDS.format(where=""))
def passes(spark, sf_dir):
    return attempts_to_pass(_attempts(spark, sf_dir), ["l_orderkey"], "l_linenumber")


@query("attempts_to_pass_capped", _ENDS.format(where="WHERE l_linenumber <= 3"))
def passes_capped(spark, sf_dir):
    return attempts_to_pass(_attempts(spark, sf_dir), ["l_orderkey"], "l_linenumber", cap=3)


@query(
    "attempts_run",
    f"""
SELECT l_orderkey, count(*) AS made FROM lineitem JOIN ({_ENDS.format(where="")}) USING (l_orderkey)
WHERE l_linenumber <= attempts GROUP BY l_orderkey""",
)
def made(spark, sf_dir):
    rows = attempts_run(_attempts(spark, sf_dir), ["l_orderkey"], "l_linenumber")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("made"))


@query(
    "latest_attempt",
    """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value, arg_max(props, event_id) AS props
FROM events GROUP BY user_id""",
)
def latest(spark, sf_dir):
    return latest_attempt(table(spark, sf_dir, "events").drop("ts"), ["user_id"], "event_id")


@query(
    "watched",
    """
SELECT doc_id FROM documents WHERE doc_id % 7 NOT IN (1, 2, 4, 6)""",
)
def watched_files(spark, sf_dir):
    """Files in folders and under names that count as activity, beside those that do not."""
    names = ["src/a.py", ".git/index", "a/_grade/x", ".gitignore", "a/b/.DS_Store", "_grades/x", "instruction.md"]
    path = F.get(F.array(*map(F.lit, names)), F.col("doc_id") % 7)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return watched(files).select("doc_id")


@query("suppress_repeats_pruned", ORACLES["suppress_repeats"])
def repeats_pruned(spark, sf_dir):
    """The same rows, with the runs that window functions can tell kept from the fold."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts_ms")
    return suppress_repeats(rows, "user_id", "event_type", "ts_ms", "event_id", GAP_MS, prune=True).select("event_id", "user_id")
