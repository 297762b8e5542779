"""Points in intervals, against a plain loop."""

import random

from ledgerline.operators import intervals
from ledgerline.operators.intervals import FOREVER, within


def test_equal_plain_loop(spark, monkeypatch):
    rng = random.Random(6)
    scale = lambda: rng.choice([1, 50, 5_000, 10**6, 10**9, 10**12])
    spans = []
    for n in range(300):
        start = rng.randrange(-2 * 10**12, 2 * 10**12) if n % 3 else rng.randrange(0, 5_000)
        spans.append((f"k{n % 4}", n, start, start + rng.randrange(scale()) if n % 7 else None))
    spans += [("k0", 1000, None, 5), ("k0", 1001, 9, 3), ("k0", 1002, 0, 1024), ("k0", 1003, -1024, 65_536)]
    points = [(f"k{rng.randrange(5)}", i, rng.choice(spans)[2]) for i in range(200)]
    points = [(k, i, at if at is None or i % 2 else at + rng.randrange(-3, 3 + scale())) for k, i, at in points]
    points += [("k0", 900 + i, at) for i, at in enumerate((-1025, -1024, -1, 0, 1023, 1024, 65_535, 65_536, FOREVER, None))]
    p = spark.createDataFrame(points, "k string, i long, at long")
    s = spark.createDataFrame(spans, "k string, n long, start long, end long")
    want = sorted((i, n) for k, i, at in points for l, n, start, end in spans
                  if k == l and at is not None and abs(at) < FOREVER and start is not None and start <= at and (end is None or at < end))
    for fan, widths in ((64, 6), (2, 40), (1 << 16, 2)):
        monkeypatch.setattr(intervals, "FAN", fan)
        monkeypatch.setattr(intervals, "WIDTHS", widths)
        if fan == 2:  # many widths make long expressions
            monkeypatch.setattr(intervals, "NARROW", 1 << 25)
            monkeypatch.setattr(intervals, "WIDTHS", 12)
        else:
            monkeypatch.setattr(intervals, "NARROW", 1 << 10 if fan == 64 else 1 << 20)
        if fan == 1 << 16:  # two widths only: the wider one covers what is long
            monkeypatch.setattr(intervals, "NARROW", 1 << 24)
        got = sorted((r.i, r.n) for r in within(p, s, ["k"], "at").collect())
        assert got == want
    assert len(want) > 200


def test_buckets_stay_on_executors(spark):
    """Buckets of intervals without an end are a hundred times the intervals: no side of the join is broadcast."""
    points = spark.createDataFrame([("a", 1, 5), ("b", 2, 10**12), ("b", 3, 4)], "k string, i long, at long")
    spans = spark.createDataFrame([("a", 1, 0, None), ("b", 2, 5, None)], "k string, n long, start long, end long")
    found = within(points, spans, ["k"], "at")
    assert sorted((r.i, r.n) for r in found.collect()) == [(1, 1), (2, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().toString()
