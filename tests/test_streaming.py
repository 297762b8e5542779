"""Streams in many batches, out of order within the delay, against the same models as the batch operators."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from ledgerline.operators.reports import event_snippet
from ledgerline.operators.scoring import latest_attempt
from ledgerline.operators.usage import harvest
from ledgerline.sources.files import log_line_stream, log_lines
from ledgerline.streaming.heartbeat import heartbeats_stream
from ledgerline.streaming.io import BATCH, read_upserts, run_to_table, split_late, upsert_stream
from ledgerline.streaming.keyed import (
    BUCKETS, idle_gaps_stream, replay_leases_stream, sliding_window_allow_stream, suppress_repeats_stream, token_bucket_stream,
)
from ledgerline.streaming.usage import harvest_stream
from tests.test_queue import SCHEMA as COMMANDS
from tests.test_queue import model as model_queue
from tests.test_queue import random_log
from tests.test_ratelimit import model_bucket, model_window, only_calls, random_rows

CALLS = "id long, k string, ts long, kind string, cost long"


def stream(spark, folder, schema, batches):
    """A stream that takes one batch of rows at a time, in order."""
    folder.mkdir()
    names = [f.split()[0] for f in schema.split(", ")]
    for n, rows in enumerate(batches):
        path = folder / f"{n:03}.json"
        path.write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def shuffled(rows, at, seed, spread, size):
    """Rows jostled by up to ``spread`` and cut into batches; a last row far ahead pushes the rest out."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[at] + rng.randrange(spread))
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_window_stream(spark, tmp_path):
    rows = random_rows(11, 300, 400_000)
    last = [(999, "end", 10_000_000, "call", 1)]
    df = stream(spark, tmp_path / "in", CALLS, [*shuffled(rows, 2, 1, 9_000, 60), last])
    out = sliding_window_allow_stream(df, "k", "ts", "id", 3, 20_000, kind="kind", delay="10 seconds")
    got = {r.id: (r.allowed, r.remaining) for r in run_to_table(out, "t").filter("k <> 'end'").collect()}
    assert got == model_window(rows, 3, 20_000)


def test_bucket_stream_and_late_rows(spark, tmp_path):
    rows = only_calls(random_rows(12, 300, 400_000))
    late = [(500, "hot", 1, "call", 1)]
    last = [(999, "end", 10_000_000, "call", 1)]
    df = stream(spark, tmp_path / "in", CALLS, [*shuffled(rows, 2, 2, 9_000, 60), last, late])
    out = token_bucket_stream(df, "k", "ts", "id", 0.1, 3, cost="cost", kind="kind", delay="10 seconds")
    got = {r.id: (r.allowed, r.tokens) for r in run_to_table(out, "t").filter("k <> 'end'").collect()}
    assert got == model_bucket(rows, 0.1, 3)


def test_every_row_is_emitted_waiting_or_late(spark, tmp_path):
    """Late rows go to a table of their own, rows without a time come out at once, the rest waits in state."""
    rows = only_calls(random_rows(14, 120, 400_000))
    late, none = [(500, "hot", 1, "call", 1), (501, "new", 2, "call", 1)], [(502, "hot", None, "call", 1)]
    waiting = [(600, "hot", 10_000_500, "call", 1), (601, "new", 10_000_600, "call", 1)]
    batches = [*shuffled(rows, 2, 2, 9_000, 60), [(999, "end", 10_000_000, "call", 1), *waiting], [*late, *none]]
    df = stream(spark, tmp_path / "in", CALLS, batches)
    out = token_bucket_stream(df, "k", "ts", "id", 0.1, 3, cost="cost", kind="kind", delay="10 seconds", keep_late=True)
    places = [str(tmp_path / name) for name in ("on_time", "late", "progress")]
    split_late(out, *places).awaitTermination()
    done, gone = (spark.read.parquet(p) for p in places[:2])
    assert {r.id for r in gone.collect()} == {500, 501} and {r.allowed for r in gone.collect()} == {None}
    got = {r.id: (r.allowed, r.tokens) for r in done.collect()}
    assert got.pop(502) == (None, None) and got == model_bucket(rows, 0.1, 3)
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(places[2])
    assert state.count() == len(waiting) + 1  # and the row that pushed the others out
    assert done.count() + gone.count() + state.count() == sum(map(len, batches))


def undone(progress):
    """The last micro-batch as if the driver had been lost after its rows were written."""
    for name in ("3", ".3.crc"):
        (progress / "commits" / name).unlink(missing_ok=True)


def test_split_and_upsert_are_idempotent(spark, tmp_path):
    """A micro-batch that is run twice leaves one row per key, and rows of older batches do not come back."""
    schema = "k string, n long, v string"
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z"), ("c", 1, "w")], [("a", 2, "old"), ("b", 1, "tie")], [("d", 1, "u")]]
    path, progress = str(tmp_path / "t"), tmp_path / "progress"
    run = lambda: upsert_stream(stream_again(), path, ["k"], ["n"], str(progress), buckets=3).awaitTermination()
    source = stream(spark, tmp_path / "in", schema, batches)
    stream_again = lambda: source
    run()
    want = {("a", 3, "z"), ("b", 1, "tie"), ("c", 1, "w"), ("d", 1, "u")}
    assert {tuple(r) for r in read_upserts(spark, path).select("k", "n", "v").collect()} == want
    undone(progress)
    run()
    assert sorted(tuple(r) for r in read_upserts(spark, path).select("k", "n", "v").collect()) == sorted(want)
    flagged = source.withColumn("late", F.col("n") > 1)
    places = [str(tmp_path / n) for n in ("on", "late", "p2")]
    for _ in range(2):
        split_late(flagged, *places).awaitTermination()
        undone(tmp_path / "p2")
    assert spark.read.parquet(places[0]).count() == 5 and spark.read.parquet(places[1]).count() == 2


def test_null_times_in_every_stream(spark, tmp_path):
    rows = [(1, "a", None, "call", 1), (2, "a", 10_000, "call", 1), (3, "b", None, "call", 1), (9, "end", 9_000_000, "call", 1)]
    make = lambda n: stream(spark, tmp_path / n, CALLS, [rows[:1], rows[1:3], rows[3:]])
    out = sliding_window_allow_stream(make("a"), "k", "ts", "id", 3, 20_000, kind="kind", delay="1 second")
    assert {r.id: r.allowed for r in run_to_table(out, "t").filter("k <> 'end'").collect()} == {1: None, 2: True, 3: None}
    texts = make("b").withColumnRenamed("kind", "text")
    assert {r.id for r in run_to_table(suppress_repeats_stream(texts, "k", "text", "ts", "id", delay="1 second"), "t").collect() if r.k != "end"} == {2}
    assert run_to_table(idle_gaps_stream(make("c"), "k", "ts", "id", delay="1 second"), "t").collect() == []


def test_harvest_of_growing_streams(spark, tmp_path):
    """Usage after every micro-batch; files that grew are read again and count once."""
    turn = lambda *counts: "".join(json.dumps({"type": "turn.completed", "usage": {"input_tokens": n}}) + "\n" for n in counts)
    steps = [
        ({"r/t/1/stdout": turn(10, 20), "r/t/2/stderr": turn(7) + "x\n"}, {("t", 1): 20, ("t", 2): 7}),
        ({"r/t/1/stdout": turn(10, 20) + "plain\n" + turn(15), "r/u/1/stdout": "{"}, {("t", 1): 45, ("t", 2): 7}),
        ({"r/t/2/stdout": turn(9, 8), "r/u/1/stdout": '{"type":"result","usage":{"input_tokens":3}}'}, {("t", 1): 45, ("t", 2): 24, ("u", 1): 3}),
        ({"r/t/2/stdout": turn(1, 2, 3, 4)}, {("t", 1): 45, ("t", 2): 7, ("u", 1): 3}),
    ]
    root, out = tmp_path / "runs", str(tmp_path / "usage")
    for files, want in steps:
        for name, body in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(body)
        usage = harvest_stream(log_line_stream(spark, str(root), settle_ms=0))
        upsert_stream(usage, out, ["run_id", "task_id", "attempt"], [BATCH], f"{out}-progress", buckets=2).awaitTermination()
        got = {(r.task_id, r.attempt): r.usage["input"] for r in read_upserts(spark, out).collect()}
        batch = {(r.task_id, r.attempt): r.usage["input"] for r in harvest(log_lines(spark, str(root)), whole=False).collect()}
        assert got == want == batch


def test_heartbeats_while_silent(spark, tmp_path):
    """Rows come while nothing does; a key that stays silent is given up."""
    df = stream(spark, tmp_path / "in", "k string, n long", [[("a", 1), ("b", 1)]])
    out = heartbeats_stream(df, "k", interval_ms=1_000, slack_ms=100, ttl_ms=6_000)
    query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "p")).trigger(processingTime="200 milliseconds") \
        .format("memory").queryName("beats").start()
    try:
        deadline = time.time() + 60
        rows = []
        while time.time() < deadline and len(rows) < 4:
            time.sleep(0.5)
            rows = spark.table("beats").collect()
        assert {r.k for r in rows} == {"a", "b"} and all(r.idle_ms >= 900 and r.message.startswith("still running ") for r in rows)
        before, now = -1, len(rows)
        while time.time() < deadline + 60 and before != now:  # a key that beats does so every second
            time.sleep(5)
            before, now = now, spark.table("beats").count()
        assert before == now  # no state, no timers
    finally:
        query.stop()


def test_queue_stream(spark, tmp_path):
    rows = random_log(13, 250)
    rows = [(*r[:2], r[2] * 1000, *r[3:5], *[v and v * 1000 for v in r[5:7]], r[7]) for r in rows]
    last = [("end", 9_999, 100_000_000, "lease", None, None, 1, None)]
    df = stream(spark, tmp_path / "in", COMMANDS, [*shuffled(rows, 2, 3, 4_000, 50), last])
    out = run_to_table(replay_leases_stream(df, 3, delay="5 seconds"), "t").filter("queue_id <> 'end'")
    got = {r.seq: (r.ready, r.leased, r.dead) if r.op == "count" else (r.done, r.out_msg, r.out_attempts) for r in out.collect()}
    assert got == model_queue(rows, 3)[0]


def test_repeats_and_gaps_stream(spark, tmp_path):
    texts = [(0, "a", 0, "x"), (1, "a", 1500, "x"), (2, "a", 2500, "x"), (3, "a", 2600, "y"), (4, "a", 2700, "x"), (5, "a", 2800, " "),
             (6, "a", 30_000, "x"), (9, "end", 9_000_000, "x")]
    texts = [(i, k, 10_000 + ts, text) for i, k, ts, text in texts]  # time 0 is where watermarks begin
    schema = "id long, k string, ts long, text string"
    batches = [[texts[1], texts[0]], [texts[3], texts[2], texts[4]], texts[5:7], texts[7:]]
    out = suppress_repeats_stream(stream(spark, tmp_path / "a", schema, batches), "k", "text", "ts", "id", delay="1 second")
    assert {r.id for r in run_to_table(out, "t").collect() if r.k == "a"} == {0, 2, 3, 4, 6}
    out = idle_gaps_stream(stream(spark, tmp_path / "b", schema, batches), "k", "ts", "id", delay="1 second")
    assert [(r.id, r.idle_ms) for r in run_to_table(out, "t").collect() if r.k == "a"] == [(6, 27_200)]


def test_many_keys_share_state(spark, tmp_path):
    """State has an entry per bucket of keys and micro-batch, null keys too, and forgets what has gone stale."""
    keys = [None, *(f"k{n}" for n in range(2 * BUCKETS))]
    rows = [(n, k, at + n % 7, "x") for at in (10_000, 10_900, 60_000) for n, k in enumerate(keys)]
    batches = [rows[: len(keys)], rows[len(keys) : 2 * len(keys)], rows[2 * len(keys) :]]
    df = stream(spark, tmp_path / "in", "id long, k string, ts long, text string", batches)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    repeats = suppress_repeats_stream(df, "k", "text", "ts", "id", 2_000, delay="1 second")
    repeats.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(len(keys)))  # the first of each key, not the repeats
    state = spark.read.format("statestore")
    assert 0 < state.option("stateVarName", "waiting").load(progress).count() <= BUCKETS
    assert state.option("stateVarName", "states").load(progress).count() == 0


def test_lines_and_latest_attempt(spark, tmp_path):
    for run, name, text in [("r1", "stdout", '{"type":"system"}\nhello\n'), ("r2", "stderr.log", "bad\n"), ("r2", "notes", "no\n")]:
        (tmp_path / "runs" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / run / name).write_text(text)
    lines = log_line_stream(spark, str(tmp_path / "runs"), settle_ms=0).withColumn("label", event_snippet("text"))
    assert {(r.run_id, r.stream, r.label) for r in run_to_table(lines, "t").collect()} == {
        ("r1", "stdout", "cli system"), ("r1", "stdout", "hello"), ("r2", "stderr", "bad")}
    rows = stream(spark, tmp_path / "in", "t string, attempt long, report string", [[("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z")], [("a", 2, "w")]])
    out = run_to_table(latest_attempt(rows, ["t"], "attempt"), "t", "update")
    assert {(r.t, r.report) for r in latest_attempt(out, ["t"], "_batch").collect()} == {("a", "z"), ("b", "y")}
