import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import whitening as module
from ledgerline.llm.whitening import whiten
from tests.llm.brute import whitened
from tests.llm.conftest import SMALL


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def matrix(rows):
    ids = sorted({r.vec_id for r in rows})
    at = {i: k for k, i in enumerate(ids)}
    out = np.full((len(ids), max(r.component for r in rows)), np.nan)
    for r in rows:
        out[at[r.vec_id], r.component - 1] = r.whitened
    return ids, out


@pytest.mark.parametrize("share", [1 / 1000, 1e9])
def test_equal_plain_version(spark, monkeypatch, share):
    """Many equal vectors, one of them a third of all rows; hot vectors broadcast or all joined by shuffle."""
    monkeypatch.setattr(module, "HOT_SHARE", share)
    rng = random.Random(2)
    base = [[rng.gauss(0, 1 + d) for d in range(6)] for _ in range(40)]
    rows = [(i, base[0] if i % 3 == 0 else rng.choice(base)) for i in range(300)]
    got = whiten(table_of(spark, rows).repartition(7), components=4).collect()
    cov, deviations, n = whitened([v for _, v in rows], 4)
    values, vectors = np.linalg.eigh(np.array(cov))
    assert len(got) == 300 * 4 and {r.n for r in got} == {n}
    assert all(r.deviation == deviations[r.vec_id] for r in got)
    ids, y = matrix(got)
    x = np.array([[np.floor(64 * c) for c in v] for _, v in rows])
    for k in range(4):
        want = (x - x.mean(axis=0)) @ vectors[:, -1 - k] / np.sqrt(values[-1 - k])
        assert np.allclose(y[:, k], want, atol=1e-9) or np.allclose(y[:, k], -want, atol=1e-9)
        (share_of,) = {r.explained for r in got if r.component == k + 1}
        assert share_of == pytest.approx(values[-1 - k] / np.trace(cov), rel=1e-9)
    assert np.allclose(np.cov(y.T, bias=True), np.eye(4), atol=1e-9)
    (error,) = {r.identity_error for r in got}
    assert 0 <= error < 1e-9


def test_table_and_weights_of_one(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = whiten(table).collect()
    assert len(got) == table.count() * 32 and got[0].identity_error < 1e-9
    assert [r.explained for r in sorted(got, key=lambda r: r.component)][::table.count()] == sorted({r.explained for r in got}, reverse=True)
    twice = table.unionByName(table)
    plain = {(r.vec_id, r.component): r.whitened for r in whiten(table, weights="one").collect()}
    again = whiten(twice, weights="one").collect()
    assert {r.n for r in again} == {table.count()} and len(again) == 2 * len(plain)
    assert all(r.whitened == plain[r.vec_id, r.component] for r in again)
    with pytest.raises(ValueError):
        whiten(table, weights="two")


def test_same_on_any_partitioning(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    one, other = ({(r.vec_id, r.component): (r.whitened, r.explained, r.deviation) for r in whiten(table.repartition(k)).collect()} for k in (1, 9))
    assert one == other


def test_large_entries_and_exact_sums(spark):
    rows = [(1, [6e7, 1.0]), (2, [0.0, 2.0]), (3, [-6e7, 1.5]), (4, [1e300, 2.0])]
    got = whiten(table_of(spark, rows[:3])).collect()
    _, deviations, _ = whitened([v for _, v in rows[:3]], 2)
    assert {r.vec_id: r.deviation for r in got if r.component == 1} == {i + 1: d if d < 2**63 else None for i, d in enumerate(deviations)}
    assert {r.deviation for r in whiten(table_of(spark, rows)).collect()} == {None}  # beyond a long


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (6, [1.0]), (7, [0.5, 0.0]), (7, [0.5, 0.0]), (8, []), (9, [1.0, 2.0, 3.0])]
    table = table_of(spark, rows)
    for name in ("x", "fp", "w", "key", "y", "component", "n"):
        table = table.withColumn(name, F.lit("z"))
    got = whiten(table).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got if r.vec_id) == [
        (False, 1, 1), (False, 1, 2), (False, 7, 1), (False, 7, 1), (False, 7, 2), (False, 7, 2)]
    assert sum(r.vec_id is None for r in got) == 2 and {r.n for r in got} == {4}
    assert whiten(table.where("vec_id = 7")).collect() == []  # no variance
    assert whiten(table.where("vec_id in (2, 3, 8)")).collect() == []
    flat = whiten(table_of(spark, [(i, [float(i), 5.0, 2.0 * i]) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1}  # one direction has variance
