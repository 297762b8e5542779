"""Command logs and change logs: lease queues and JSON patches over ``events``, one per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators.ordered import ordered
from ledgerline.operators.patch import apply_patches
from ledgerline.operators.queue import queue_dead_letters, queue_depth, queue_items, replay_leases, replay_outcomes, replay_state
from ledgerline.plans.registry import events, query, table
from ledgerline.session import scratch_path

HOUR_MS, VISIBLE_MS = 3_600_000, 2 * 86_400_000


def _commands(spark, sf_dir):
    """Signups and purchases enqueue (a purchase an hour later), views lease, clicks ack and errors nack
    whatever the user's last view leased."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "enqueue").when(kind == "view", "lease").when(kind == "click", "ack").otherwise("nack")
    rows = ordered(events(spark, sf_dir), ["user_id"], ["ts_ms", "event_id"])
    rows = rows.running_max("last_view", F.when(kind == "view", F.col("event_id"))).rows()
    return rows.select(
        F.col("user_id").alias("queue_id"), F.col("event_id").alias("seq"), F.col("ts_ms").alias("now_ms"), op.alias("op"),
        F.when(op == "enqueue", F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("msg_id"),
        F.when(kind == "purchase", HOUR_MS).otherwise(0).cast("long").alias("delay_ms"),
        F.lit(VISIBLE_MS).cast("long").alias("visibility_ms"),
        F.when(op.isin("ack", "nack"), F.col("last_view")).alias("lease_ref"),
    )


def stage_commands(spark, sf_dir) -> str:
    """The commands as a folder of files; returns its path."""
    path = scratch_path(spark, "commands")
    _commands(spark, sf_dir).write.parquet(path)
    return path


# Items are rows of a list that walks with the log. ``gone`` marks the item an ack removed.
_FAIL = """{{'id': i.id, 'n': i.n + 1, 'at': now_ms, 'ref': NULL::BIGINT, 'until': 0::BIGINT, 'dead': i.n + 1 >= 3}}"""
_REPLAY = f"""
WITH RECURSIVE cmds AS (
  SELECT user_id AS queue_id, event_id AS seq, epoch_us(ts) // 1000 AS now_ms, event_type,
         row_number() OVER w AS rn, max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS last_view
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
walk AS (
  SELECT queue_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS now_ms, NULL::VARCHAR AS event_type, NULL::BIGINT AS got, NULL::BIGINT AS got_n,
         []::STRUCT(id BIGINT, n BIGINT, "at" BIGINT, ref BIGINT, until BIGINT, dead BOOLEAN)[] AS items
  FROM (SELECT DISTINCT queue_id FROM cmds)
  UNION ALL
  SELECT queue_id, rn, seq, now_ms, event_type, pick.id, pick.n,
    CASE
      WHEN event_type IN ('signup', 'purchase') THEN list_append(items,
        {{'id': seq, 'n': 0::BIGINT, 'at': now_ms + CASE event_type WHEN 'purchase' THEN {HOUR_MS} ELSE 0 END, 'ref': NULL::BIGINT, 'until': 0::BIGINT, 'dead': false}})
      WHEN event_type = 'view' THEN list_transform(items, lambda i: CASE WHEN i.id = pick.id
        THEN {{'id': i.id, 'n': i.n, 'at': i.at, 'ref': seq, 'until': now_ms + {VISIBLE_MS}, 'dead': false}} ELSE i END)
      WHEN event_type = 'click' THEN list_filter(items, lambda i: i.id IS DISTINCT FROM pick.id)
      ELSE list_transform(items, lambda i: CASE WHEN i.id = pick.id THEN {_FAIL.format()} ELSE i END) END
  FROM (
    SELECT queue_id, rn, seq, now_ms, event_type, items,
      CASE
        WHEN event_type IN ('signup', 'purchase') THEN NULL
        WHEN event_type = 'view' THEN list_sort(list_transform(list_filter(items, lambda i: NOT i.dead AND i.ref IS NULL AND i.at <= now_ms),
          lambda i: {{'at': i.at, 'id': i.id, 'n': i.n}}))[1]
        ELSE list_transform(list_filter(items, lambda i: i.ref = last_view), lambda i: {{'at': i.at, 'id': i.id, 'n': i.n + (event_type = 'error')::INT}})[1] END AS pick
    FROM (
      SELECT c.queue_id, c.rn, c.seq, c.now_ms, c.event_type, c.last_view,
        CASE WHEN c.event_type IN ('signup', 'purchase') THEN w.items ELSE list_transform(w.items, lambda i:
          CASE WHEN NOT i.dead AND i.ref IS NOT NULL AND i.until <= c.now_ms THEN {_FAIL.format().replace("now_ms", "c.now_ms")} ELSE i END) END AS items
      FROM walk w JOIN cmds c ON c.queue_id = w.queue_id AND c.rn = w.rn + 1)))"""
_LEFT = ", left_over AS (SELECT queue_id, unnest(arg_max(items, rn)) AS i, max(now_ms) AS last_ms FROM walk GROUP BY queue_id)"


@query(
    "replay_leases",
    _REPLAY + """
SELECT seq, event_type IN ('signup', 'purchase') OR got IS NOT NULL AS done,
       CASE WHEN event_type IN ('signup', 'purchase') THEN lpad(seq::VARCHAR, 12, '0') ELSE lpad(got::VARCHAR, 12, '0') END AS out_msg,
       CASE WHEN event_type IN ('signup', 'purchase') THEN 0 ELSE got_n END::BIGINT AS out_attempts
FROM walk WHERE rn > 0""",
)
def outcomes(spark, sf_dir):
    return replay_outcomes(_commands(spark, sf_dir)).select("seq", "done", "out_msg", "out_attempts")


@query(
    "replay_leases_carried",
    _REPLAY + _LEFT + """
SELECT queue_id, lpad(i.id::VARCHAR, 12, '0') AS msg_id, i.n AS attempts, i.at AS available_at, i.ref AS lease_ref, i.until AS lease_until, i.dead AS dead
FROM left_over""",
)
def carried(spark, sf_dir):
    """The messages left, with the log cut in two at its middle and the state carried over."""
    commands = _commands(spark, sf_dir)
    middle = commands.agg(F.avg("now_ms")).first()[0]
    early, late = commands.filter(F.col("now_ms") < middle), commands.filter(F.col("now_ms") >= middle)
    return queue_items(replay_state(late, state_in=replay_state(early)))


@query(
    "queue_depth",
    _REPLAY + _LEFT + f"""
, later AS (SELECT queue_id, i, (SELECT max(epoch_us(ts) // 1000) FROM events) - {HOUR_MS * 12} AS now FROM left_over)
SELECT queue_id, count(*) FILTER (WHERE NOT gone AND (lapsed OR (i.ref IS NULL AND i.at <= now))) AS ready,
       count(*) FILTER (WHERE i.ref IS NOT NULL AND i.until > now) AS leased, count(*) FILTER (WHERE gone) AS dead
FROM (SELECT *, i.dead OR (lapsed AND i.n + 1 >= 3) AS gone FROM (SELECT *, i.ref IS NOT NULL AND i.until <= now AS lapsed FROM later))
GROUP BY queue_id""",
)
def depth(spark, sf_dir):
    """Half a day before the last event of all, so that some leases have run out and some have not."""
    commands = _commands(spark, sf_dir)
    items = replay_leases(commands)[1]
    now = commands.agg(F.max("now_ms")).first()[0] - 12 * HOUR_MS
    return queue_depth(items, now)


@query(
    "queue_dead_letters",
    _REPLAY + _LEFT + "SELECT queue_id, lpad(i.id::VARCHAR, 12, '0') AS msg_id, i.n AS attempts FROM left_over WHERE i.dead",
)
def dead_letters(spark, sf_dir):
    return queue_dead_letters(replay_leases(_commands(spark, sf_dir))[1])


# --- JSON patches -----------------------------------------------------------------------------


def _change_log(spark, sf_dir):
    return apply_patches(*_log(spark, sf_dir, '{"seen":{}}', "/seen/"))


def _log(spark, sf_dir, doc, place):
    """Every user has a document; an event sets a key of its own, an error replaces the purchase."""
    rows = table(spark, sf_dir, "events")
    docs = rows.select(F.col("user_id").alias("doc_id")).distinct().withColumn("doc", F.lit(doc))
    is_error = F.col("event_type") == "error"
    ops = rows.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(is_error, "replace").otherwise("add").alias("op"),
        F.concat(F.lit(place), F.when(is_error, "purchase").otherwise(F.col("event_type"))).alias("path"),
        F.col("value").cast("string").alias("value"),
    )
    return docs, ops


_BAD = """
WITH bad AS (
  SELECT user_id FROM events GROUP BY user_id
  HAVING min(event_id) FILTER (WHERE event_type = 'error') < coalesce(min(event_id) FILTER (WHERE event_type = 'purchase'), 1e18))"""


@query(
    "apply_patches",
    _BAD + """
SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN 'purchase' ELSE event_type END AS key, arg_max(value, event_id) AS value
FROM events WHERE user_id NOT IN (SELECT user_id FROM bad) GROUP BY ALL""",
)
def patched(spark, sf_dir):
    good, _ = _change_log(spark, sf_dir)
    seen = F.from_json(F.get_json_object("doc", "$.seen"), "map<string,double>")
    return good.select("doc_id", F.explode(seen).alias("key", "value"))


@query(
    "patch_flat",
    """
WITH bad AS (
  SELECT user_id FROM events GROUP BY user_id
  HAVING min(event_id) FILTER (WHERE event_type = 'error') < coalesce(min(event_id) FILTER (WHERE event_type = 'purchase'), 1e18)),
kept AS (
  SELECT user_id, CASE event_type WHEN 'error' THEN 'purchase' ELSE event_type END AS key, max(event_id) AS last, min(event_id) AS first
  FROM events WHERE user_id NOT IN (SELECT user_id FROM bad) GROUP BY ALL)
SELECT user_id AS doc_id, '{"n": 0, ' || string_agg('"' || key || '": ' || last, ', ' ORDER BY first) || '}' AS doc FROM kept GROUP BY user_id""",
)
def flat(spark, sf_dir):
    """Flat documents: the last writer of each entry stands, entries in the order in which they came."""
    docs, ops = _log(spark, sf_dir, '{"n":0}', "/")
    return apply_patches(docs, ops.withColumn("value", F.col("seq").cast("string")))[0]


@query("patch_rejects", _BAD + "SELECT user_id AS doc_id, 'nothing at purchase' AS error FROM bad")
def rejected(spark, sf_dir):
    return _change_log(spark, sf_dir)[1]


@query(
    "patch_arrays",
    """
SELECT user_id AS doc_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id DESC) AS ids
FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def arrays(spark, sf_dir):
    """Each event is put in front of a list; an error puts one in front too and takes it out again."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    docs = rows.select("doc_id").distinct().withColumn("doc", F.lit('{"ids":[]}'))
    steps = F.array(F.lit("add"), F.lit("test"), F.lit("remove"))
    ops = rows.select("doc_id", "event_id", "event_type", F.posexplode(steps).alias("step", "op"))
    ops = ops.filter("step < 2 or event_type = 'error'").select(
        "doc_id", (F.col("event_id") * 3 + F.col("step")).alias("seq"), "op", F.lit("/ids/0").alias("path"),
        F.col("event_id").cast("string").alias("value"),
    )
    good, _ = apply_patches(docs, ops)
    ids = F.from_json(F.get_json_object("doc", "$.ids"), "array<long>")
    return good.select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids")).filter("ids <> ''")
