"""Repeats, gaps, resets and snapshots, on keys of every size."""

import random

import pytest

from ledgerline.operators.activity import Repeats, idle_gaps, mark_repeats, no_progress, snapshot_diff, told_repeats, watched
from ledgerline.operators.folds import keyed_fold
from ledgerline.operators.ordered import ordered
from pyspark.sql import functions as F


def rows_of(seed, n, span, texts="xxxy "):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", rng.randrange(span), rng.choice(texts)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, ts long, text string").repartition(3)


def in_order(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        keys.setdefault(r[1], []).append(r)
    return keys


@pytest.mark.parametrize("seed,span,max_rows", [(1, 40_000, 10**6), (2, 40_000, 60), (3, 9_000, 60)])
def test_repeats(spark, seed, span, max_rows):
    """Dense runs of one text make chunks that depend on each other."""
    rows = rows_of(seed, 400, span, "xxxxxxxxxy " if seed < 3 else "x")
    want = set()
    for run in in_order(rows).values():
        last, at = None, None
        for i, _, t, text in run:
            if text.strip() and not (text == last and t - at < 300):
                last, at = text, t
                want.add(i)
    out = mark_repeats(table(spark, rows), "k", "text", "ts", "id", 300, max_rows=max_rows)
    assert {r.id for r in out.filter("emitted").collect()} == want and out.count() == len(rows)


def test_repeats_that_windows_tell(spark):
    """Only runs of one text that last as long as the gap reach the fold."""
    rng = random.Random(8)
    for span, texts in ((40_000, "xyz "), (9_000, "x"), (20_000, "xxxy ")):
        rows = rows_of(rng.randrange(99), 300, span, texts) + [(900, "hot", None, "x"), (901, "k1", 5, None)]
        folded = keyed_fold(table(spark, rows), ["k"], ["ts", "id"], Repeats("text", "ts", 300))
        out = mark_repeats(table(spark, rows), "k", "text", "ts", "id", 300, prune=True)
        assert {r.id: r.emitted for r in out.collect()} == {r.id: r.emitted for r in folded.collect()}
        fed = told_repeats(table(spark, rows), ["k"], ["ts", "id"], "text", 300).filter("_fed").count()
        assert fed < 120 if texts == "xyz " else fed <= 302


@pytest.mark.parametrize("max_rows", [10**6, 50])
def test_gaps_and_resets(spark, max_rows):
    rows = rows_of(4, 300, 20_000, "xxy")
    gaps, resets = {}, {}
    for run in in_order(rows).values():
        for a, b in zip(run, run[1:]):
            if b[2] - a[2] >= 90:
                gaps[a[0]] = b[2] - a[2]
        last = None
        for i, _, _, text in run:
            resets[i] = text == last
            last = None if text == last else text
    df = table(spark, rows)
    got = {r.id: r.idle_ms for r in idle_gaps(df, "k", "ts", "id", 100, 10, max_rows=max_rows).collect()}
    assert got == gaps
    got = {r.id: r.reset for r in no_progress(df, "k", ["ts", "id"], ["text"], max_rows=max_rows).collect()}
    assert got == resets


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_window_functions(spark, max_rows):
    rows = rows_of(5, 250, 500)
    want = {}
    for run in in_order(rows).values():
        total, top = 0, None
        for n, (i, _, t, text) in enumerate(run):
            total += t
            top = i if text == "y" and (top is None or i > top) else top
            want[i] = (run[n - 1][3] if n else None, run[n + 1][0] if n + 1 < len(run) else None, total, top)
    o = ordered(table(spark, rows), ["k"], ["ts", "id"], max_rows)
    o = o.lag("before", F.col("text")).lead("after", F.col("id")).running_sum("total", F.col("ts"))
    out = o.running_max("top", F.when(F.col("text") == "y", F.col("id"))).rows()
    assert {r.id: (r.before, r.after, r.total, r.top) for r in out.collect()} == want


def test_snapshots(spark):
    schema = "path string, mtime_ns long, size long"
    a = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("n", None, 1)], schema)
    b = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1), ("n", None, 1)], schema)
    got = {r.path: r.change for r in snapshot_diff(a, b, "path", ["mtime_ns", "size"]).collect()}
    assert got == {"b": "wrote", "d": "wrote", "c": "removed"}
    paths = ["src/a.py", ".git/x", "x/_grade/y", "instruction.md", "d/.DS_Store", "e/__pycache__x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in watched(df).collect()} == {"src/a.py", "e/__pycache__x"}
