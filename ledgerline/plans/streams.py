"""The streaming operators over all of ``events``, in several micro-batches.

The events are laid out in three steps of time, and a last row far ahead of them under a key of its own moves the
watermark past all others, so that every event comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.scoring import latest_attempt
from ledgerline.plans import activity, limiters, logs
from ledgerline.plans.registry import ORACLES, events, query
from ledgerline.session import scratch_path
from ledgerline.streaming.io import read_upserts, run_to_table, split_late, upsert_stream
from ledgerline.streaming.keyed import (
    idle_gaps_stream, replay_leases_stream, sliding_window_allow_stream, suppress_repeats_stream, token_bucket_stream,
)

HOUR_MS = 3_600_000
#: Key and id of the row that closes a stream.
CLOSING = -1
_FILES = 4


def _laid_out(spark, rows: DataFrame, ts: str, closing: dict, late: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream: files in the order of ``ts``, one step a micro-batch, and the closing row.

    ``late`` rows come after all that: the closing row then fills a micro-batch, so that they meet its watermark.
    """
    root = scratch_path(spark, "arrivals")
    first, last = rows.agg(F.min(ts), F.max(ts)).first()
    step = (last - first) // 3 + 1
    for n in range(3):
        part = rows.filter(F.col(ts).between(first + n * step, first + (n + 1) * step - 1))
        part.repartition(_FILES).write.mode("append").parquet(root)
    end = rows.filter(F.col(ts) == last).limit(1).withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in closing.items()})
    end = end.withColumn(ts, F.lit(last + 2 * HOUR_MS).cast("long")).repartition(1)
    for _ in range(1 if late is None else _FILES):
        end.write.mode("append").parquet(root)
    if late is not None:
        late.select(*rows.columns).repartition(_FILES).write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(root)


def _events(spark, sf_dir):
    return _laid_out(spark, events(spark, sf_dir), "ts_ms", {"user_id": CLOSING, "event_id": CLOSING})


def _finish(stream, label, row="event_id"):
    return run_to_table(stream, label).filter(F.col(row) != CLOSING)


_KEY = dict(**limiters.KEY, delay="30 minutes")


@query("token_bucket_stream", ORACLES["token_bucket"])
def bucket(spark, sf_dir):
    calls = _events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    out = token_bucket_stream(calls, **_KEY, rate_per_sec=limiters.RATE, burst=limiters.BURST)
    return _finish(out, "bucket").drop("ts_ms")


@query("sliding_window_stream", ORACLES["sliding_window_allow"])
def window(spark, sf_dir):
    calls = _events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    out = sliding_window_allow_stream(calls, **_KEY, limit=limiters.LIMIT, window_ms=limiters.WINDOW_MS)
    return _finish(out, "window").drop("ts_ms")


@query("suppress_repeats_stream", ORACLES["suppress_repeats"])
def repeats(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts_ms")
    out = suppress_repeats_stream(rows, "user_id", "event_type", "ts_ms", "event_id", activity.GAP_MS, "30 minutes")
    return _finish(out, "repeats").select("event_id", "user_id")


@query(
    "idle_gaps_stream",
    f"""
SELECT user_id, event_id, idle_ms FROM (
  SELECT user_id, event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS idle_ms
  FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events)) WHERE idle_ms >= {activity.IDLE_MS} - 500""",
)
def gaps(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    out = idle_gaps_stream(rows, "user_id", "ts_ms", "event_id", activity.IDLE_MS, delay="30 minutes")
    return _finish(out, "gaps").select("user_id", "event_id", "idle_ms")


@query("replay_leases_stream", ORACLES["replay_leases"])
def leases(spark, sf_dir):
    """The command log is written out first, since a lease reference looks back over the whole log."""
    log = spark.read.parquet(logs.stage_commands(spark, sf_dir))
    commands = _laid_out(spark, log, "now_ms", {"queue_id": CLOSING, "seq": CLOSING})
    out = replay_leases_stream(commands, delay="30 minutes")
    return _finish(out, "leases", "seq").select("seq", "done", "out_msg", "out_attempts")


@query("latest_attempt_stream", ORACLES["latest_attempt"])
def latest(spark, sf_dir):
    """The batch operator on a stream: every batch emits the keys it changed, and the newest row stands."""
    stream = latest_attempt(_events(spark, sf_dir).drop("ts", "ts_ms"), ["user_id"], "event_id")
    out = latest_attempt(run_to_table(stream, "latest", "update"), ["user_id"], "_batch").drop("_batch")
    return out.filter(F.col("user_id") != CLOSING)


@query(
    "late_rows_stream",
    """
SELECT user_id, count(*) FILTER (event_id % 10 <> 0) AS on_time, count(*) FILTER (event_id % 10 = 0) AS late FROM events GROUP BY user_id""",
)
def late_rows(spark, sf_dir):
    """Every tenth event comes after the watermark has passed all of them: two tables, and no row is lost."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts_ms")
    tenth = F.col("event_id") % 10 == 0
    calls = _laid_out(spark, rows.filter(~tenth), "ts_ms", {"user_id": CLOSING, "event_id": CLOSING}, rows.filter(tenth))
    out = token_bucket_stream(calls, **_KEY, rate_per_sec=limiters.RATE, burst=limiters.BURST, keep_late=True)
    places = [scratch_path(spark, label) for label in ("on-time", "late", "progress")]
    split_late(out, *places).awaitTermination()
    done, late = (spark.read.parquet(p).filter(F.col("user_id") != CLOSING).withColumn("n", F.lit(n)) for n, p in enumerate(places[:2]))
    counts = done.select("user_id", "n").unionByName(late.select("user_id", "n")).groupBy("user_id")
    return counts.agg(F.count_if(F.col("n") == 0).alias("on_time"), F.count_if(F.col("n") == 1).alias("late"))


@query("latest_attempt_upserts", ORACLES["latest_attempt"])
def upserted(spark, sf_dir):
    """The last event of every user in a table of buckets that each micro-batch brings up to date."""
    rows, path = _events(spark, sf_dir).drop("ts", "ts_ms"), scratch_path(spark, "latest")
    upsert_stream(rows, path, ["user_id"], ["event_id"], f"{path}-progress", buckets=8).awaitTermination()
    return read_upserts(spark, path).filter(F.col("user_id") != CLOSING)
