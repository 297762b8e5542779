import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence as module
from ledgerline.llm.divergence import QuadTree, divergence, joint_sums
from tests.llm.brute import divergences


def found(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


@pytest.fixture(scope="module")
def texts():
    rng, rows = random.Random(3), []
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "é", "zz", "ö")]
    for i in range(300):
        lang, source = rng.choice(["en", "en", "de", ""]), f"s{min(int(rng.expovariate(0.1)), 40)}"
        some = rng.sample(words, 12) + [f"only{i}"[:5]]
        rows.append((i, " ".join(rng.choice(some).title() for _ in range(rng.choice([0, 1, 30, 200]))) + ", 12!", lang, source))
    return rows


@pytest.mark.parametrize("block,cells,leaf,held", [(512, 1 << 20, (8, 256), 400_000), (3, 64, (2, 4), 10), (4, 200, (4, 8), 50)])
def test_equal_plain_version(spark, monkeypatch, texts, block, cells, leaf, held):
    """The same for one tile and for many, for large and small leaves, and for counts passed on early."""
    for name, value in (("BLOCK_ROWS", block), ("TILE_CELLS", cells), ("LEAF", leaf), ("HELD_TERMS", held)):
        monkeypatch.setattr(module, name, value)
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(5)
    got = found(divergence(docs, most_terms=7))
    assert got == divergences([r[1:] for r in texts], 7) and len({r[1] for r in got}) > 20


def test_all_zero_quadrants_are_not_visited():
    """Rows 0 and 9 meet in one leaf; the others are never opened."""
    opened = []

    class Watched(QuadTree):
        def leaf(self, r, c, floor, columns):
            opened.append((r, c))
            return super().leaf(r, c, floor, columns)

    tree = Watched(32, 10_000, np.array([0, 9]), np.array([5, 6]), np.array([10, 20]))
    value, seen = joint_sums(tree, np.full(32, 2), 10_000)
    assert {c for _, c in opened} == {0} and seen[0, 9] == 256 and seen[20, 30] == 0
    assert value[0, 9] == (10 - 2) ** 2 // 2 + (2 - 20) ** 2 // 20 and value[9, 0] == (2 - 10) ** 2 // 10 + (20 - 2) ** 2 // 2


def test_odd_rows(spark, odd, empty):
    got = found(divergence(odd))
    want = divergences([(r.text, r.lang, r.source) for r in odd.collect()], 200)
    assert got == want and ("", "", "pair", "a", 0, 1) in got  # no term stands in three documents: every pair has value 0
    thrice = odd.unionByName(odd).unionByName(odd).withColumn("term", F.lit("t")).withColumn("row", F.lit(1)).withColumn("p", F.lit(2))
    assert found(divergence(thrice)) == divergences([(r.text, r.lang, r.source) for r in thrice.collect()], 200)
    assert divergence(empty).collect() == []
