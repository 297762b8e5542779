import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import topk
from ledgerline.llm.topk import Tree, top_k
from tests.llm.conftest import SMALL


def brute(rows, asked, k):
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    out = {}
    for q in asked:
        if q in v:
            score = lambda i: sum(a * b for a, b in zip(v[q], v[i]))
            out[q] = sorted(((-score(i), i) for i in v if i != q))[:k]
    return {q: [(i, -s) for s, i in best] for q, best in out.items()}


def result(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("tree,page,fan,block", [(8192, 256, 8, 512), (100, 7, 3, 7), (40, 1, 2, 3)])
def test_equal_brute_force(spark, monkeypatch, tree, page, fan, block):
    for name, value in (("TREE", tree), ("PAGE", page), ("FAN", fan), ("BLOCK", block)):
        monkeypatch.setattr(topk, name, value)
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    asked = [i for i, _ in rows if i % 20 == 0]
    assert result(top_k(table.where("vec_id % 20 = 0"), table)) == brute(rows, asked, 20)


def test_ties_lengths_and_few_candidates(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for i in range(200)] + [(500, [9.0, -3.0, 1e4])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(top_k(table, table, k=7)) == brute(rows, [i for i, _ in rows], 7)
    few = table.where("vec_id < 4")
    assert result(top_k(few, few)) == brute(rows[:4], range(4), 20)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (6, [1.0]), (6, [1.0]), (7, []), (8, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("v", F.lit(2))
    got = result(top_k(table, table))
    assert got[1] == [(6, 4096), (7, 0), (8, 0)] and set(got) == {1, 6, 7, 8}
    none = table.where("vec_id = 2")
    assert top_k(none, none).collect() == [] and top_k(table, none).collect() == [] and top_k(none, table).collect() == []


def test_large_components(spark):
    """A vector whose square does not fit 64 bits is searched like any other; scores below 2^53 are exact."""
    rows = [(i, [float(i % 7), 1.0, float(-i)]) for i in range(60)] + [(100, [6e7, 0.5, 1.0]), (101, [-6e7, 2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(top_k(table, table, k=5)) == brute(rows, [i for i, _ in rows], 5)
    wild = spark.createDataFrame([*rows, (200, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = result(top_k(wild, wild, k=5))
    assert len(got) == 63 and got[1][0][0] == 200


def clustered(rng, n, size=16, spread=3.0):
    centres = rng.normal(0, 100, (20, size))
    return np.rint(centres[rng.integers(0, 20, n)] + rng.normal(0, spread, (n, size)))


def test_stored_bounds_avoid_distances(monkeypatch):
    """On vectors in clusters a fraction of all distances is computed; with equal results, for trees of any shape."""
    rng = np.random.default_rng(5)
    for x, share in ((clustered(rng, 6_000), 0.2), (np.rint(rng.normal(0, 20, (2_000, 16))), 1.2), (np.ones((3_000, 16)), 1.2),
                     (np.rint(2.0 ** rng.uniform(0, 40, (2_000, 1)) * np.ones((1, 16))), 1.2)):
        reach, keys = float((x * x).sum(1).max()), rng.permutation(len(x))
        tree = Tree.build(keys, x, reach, topk._lifted(x[:1], reach)[0])
        again = Tree(16, **tree.blobs())
        sizes = (tree.last - tree.first)[tree.leaf]
        assert sizes.sum() == len(x) and sizes.max() <= topk.PAGE and (~tree.leaf).sum() > 0
        q, own, counted = x[::60], keys[::60], [0]
        best, names = again.search(q, own, np.full(len(q), -np.inf), reach, 5, counted)
        scores = q @ x.T
        for i in range(len(q)):
            order = [j for j in np.lexsort((keys, -scores[i])) if keys[j] != own[i]][:5]
            assert best[i].tolist() == scores[i, order].tolist() and names[i].tolist() == keys[order].tolist()
        assert counted[0] < share * len(q) * len(x)
        few = [0]
        again.search(q, own, best[:, -1], reach, 5, few)
        assert few[0] <= counted[0]


def test_covering_radii_hold():
    rng = np.random.default_rng(6)
    x = clustered(rng, 3_000)
    reach = float((x * x).sum(1).max())
    tree = Tree.build(np.arange(len(x)), x, reach, topk._lifted(x[:1], reach)[0])
    points = topk._lifted(tree.entries, reach)

    def below(node):
        return range(tree.first[node], tree.last[node]) if tree.leaf[node] else [e for c in range(tree.first[node], tree.last[node]) for e in below(c)]

    for node in range(len(tree.radius)):
        far = np.sqrt(((points[list(below(node))] - tree.pivots[node]) ** 2).sum(1))
        assert far.max() <= tree.radius[node] + 1e-6
        if tree.leaf[node]:
            assert np.allclose(far, tree.gaps[tree.first[node] : tree.last[node]], atol=1e-6)
        else:
            for child in range(tree.first[node], tree.last[node]):
                assert abs(np.sqrt(((tree.pivots[child] - tree.pivots[node]) ** 2).sum()) - tree.apart[child]) < 1e-6


def test_hot_region_and_far_trees(spark, monkeypatch):
    """A region that holds most vectors is split among trees; trees that cannot matter get no queries."""
    monkeypatch.setattr(topk, "TREE", 100)
    rng = np.random.default_rng(7)
    x = np.vstack([np.rint(rng.normal(0, 1, (700, 6)) + 500), clustered(rng, 300, 6)])
    rows = [(i, [float(c) / 64 for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 50 = 0")
    asked_ids = [i for i, _ in rows if i % 50 == 0]
    sent = []
    real = topk._searched
    monkeypatch.setattr(topk, "_searched", lambda a, *more: sent.append((a.count(), more[0].count())) or real(a, *more))
    assert result(top_k(asked, table, k=5)) == brute(rows, asked_ids, 5)
    (first, trees), (second, _) = sent
    assert first == len(asked_ids) and trees >= 10 and second < first * (trees - 1)


def test_trees_stay_on_executors(spark, monkeypatch):
    """Trees pack well, so that files of a few MB hold gigabytes: neither they nor blocks go through the driver, and
    tasks read them a few at a time."""
    plans, rows = [], []

    def recorded(df, label, **options):
        if label == "found":
            plans.append(df._jdf.queryExecution().toString())
            rows.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        return written(df, label, **options)

    written = topk.written
    monkeypatch.setattr(topk, "written", recorded)
    monkeypatch.setattr(topk, "TREE", 40)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    vectors = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(300)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert result(top_k(table, table, k=4)) == brute(vectors, [i for i, _ in vectors], 4)
    assert len(plans) == 2 and not any("Broadcast" in plan for plan in plans)
    assert rows == [str(topk.PAIRS)] * 2 and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before
