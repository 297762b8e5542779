import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import jaccard
from ledgerline.llm.jaccard import jaccard_join
from tests.llm.brute import near_components, shingle_set


@pytest.fixture(scope="module")
def planted(documents):
    """Some small documents, groups of near copies around texts, a chain, and a passage in many texts."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(60).collect()]
    rng, number = random.Random(8), 20_000
    for size in (30, 200, 500):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, size // 100, size // 30, size // 25])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((number := number + 1, " ".join(words[: rng.randrange(size - size // 12, size + 1)])))
    chain = [f"c{i}" for i in range(160)]
    for step in range(14):  # each alike to the next, not to all
        rows.append((number := number + 1, " ".join(chain[step * 6 :] + [f"d{step}"])))
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(60):  # a common passage in texts that differ
        rows.append((number := number + 1, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 40])))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,often,block,piece,hubs", [
    (4, 85, 3, 1_000_000, 256, 6), (4, 85, 1, 3000, 5, 1), (2, 70, 1, 500, 2, 2), (1, 100, 9, 2000, 7, 1)])
def test_components_equal_brute_force(spark, monkeypatch, planted, words, percent, often, block, piece, hubs):
    """The same whatever the order of n-grams, the size of tiles and of pieces of long columns, and the number of hubs."""
    for name, value in (("OFTEN", often), ("BLOCK", block), ("PIECE", piece), ("SAMPLE", 4), ("HUBS", hubs), ("BEST", min(hubs, 3)),
                        ("BROADCAST_IDS", 500_000 if hubs > 1 else 10)):
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    got = jaccard_join(docs, words=words, percent=percent).collect()
    want = near_components(planted, words, percent)
    assert {r.doc_id: r.component for r in got} == want and len(set(want.values())) < len(want)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t, words)) for i, t in planted}


def test_product_of_a_tile():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    rows = pa.table({"id": pa.array([7 * i for i in range(40)]), "hashes": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())),
                     "n": [len(s) for s in sets], "power": [0] * 40})
    pairs = [(a, b) for a in range(40) for b in range(a)]
    entries = pa.table({"a": [7 * a for a, _ in pairs], "b": [7 * b for _, b in pairs], "block_a": [0] * len(pairs), "block_b": [0] * len(pairs)})
    got = [(r["a"] // 7, r["b"] // 7) for r in jaccard._tile(40, True)(entries, rows).to_pylist()]
    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 40 * len(np.union1d(sets[a], sets[b]))
    assert got == [p for p in pairs if alike(*p)] and got
    # heads of any length drop no pair that is alike, and most of the others if they are long
    for share in (0.2, 0.6, 0.9):
        heads = rows.set_column(1, "hashes", pa.array([s[: max(1, int(share * len(s)))].tolist() for s in sets], pa.list_(pa.int64())))
        may = {(r["a"] // 7, r["b"] // 7) for r in jaccard._tile(40, False)(entries, heads).to_pylist()}
        assert set(got) <= may and (share < 0.9 or len(may) < len(pairs) / 2)


def test_keys_repeated_with_other_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(5, one), (5, two), (1, one + " x"), (9, two + " y"), (None, one + " z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component) for r in jaccard_join(docs).collect())
    assert got == [(0, 1), (1, 1), (5, 1), (5, 5), (9, 5)]


def test_odd_rows(odd, empty):
    found = [(r.doc_id, r.n_shingles, r.component) for r in jaccard_join(odd).collect()]
    assert sorted(x for x in found if x[0] in (4, 5)) == [(4, 9, 4), (4, 9, 4), (5, 9, 4)]
    assert (1, 0, 1) in found and (2, 0, 2) in found and (3, 0, 3) in found and (6, 1, 6) in found and (7, 1, 7) in found
    assert len(found) == odd.count() and jaccard_join(empty).collect() == []
    with pytest.raises(ValueError):
        jaccard_join(odd, percent=0)
