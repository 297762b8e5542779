import random

import pytest

from ledgerline.llm.common import components
from ledgerline.llm.neardup import _least_shared, near_duplicates, without_near_duplicates
from tests.llm.brute import near_components


@pytest.fixture(scope="module")
def planted(spark, documents):
    """The small documents, with chains of edited copies and a group of near copies around one text."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(80).collect()]
    rng, number = random.Random(5), 10_000
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    for _ in range(60):  # near copies, some too far from the base and from each other
        words = list(base)
        for _ in range(rng.choice([1, 2, 5, 9, 14, 18])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((number := number + 1, " ".join(words)))
    chain = [f"c{i}" for i in range(120)]
    for step in range(12):  # each alike to the next, not to all
        rows.append((number := number + 1, " ".join(chain[step * 4 :] + [f"d{step}"])))
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(40):  # a common passage in texts that differ
        rows.append((number := number + 1, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))))
    return rows


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, planted, words, percent):
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    found = near_duplicates(docs, words=words, percent=percent).collect()
    assert {r.doc_id: r.component for r in found} == near_components(planted, words, percent)
    kept = {r.doc_id for r in without_near_duplicates(docs, words=words, percent=percent).collect()}
    assert kept == set(near_components(planted, words, percent).values())


def test_odd_rows(odd, empty):
    found = [(r.doc_id, r.n_shingles, r.component) for r in near_duplicates(odd, words=3, percent=85).collect()]
    assert sorted(x for x in found if x[0] in (4, 5)) == [(4, 10, 4), (4, 10, 4), (5, 10, 4)]
    assert (1, 0, 1) in found and (2, 0, 2) in found and (3, 0, 3) in found and (6, 1, 6) in found and (7, 1, 7) in found
    assert len(found) == odd.count()
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 7, 8]
    assert near_duplicates(empty).collect() == [] and without_near_duplicates(empty).collect() == []


def test_components_of_long_chains_and_stars(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 60)] + [("900", f"{i}") for i in range(901, 960)] + [("x", "x")]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"{i:03}"] for i in range(0, 61)} == {"000"} and {found[str(i)] for i in range(900, 960)} == {"900"}
    assert len(found) == 61 + 60


def test_fewer_shared_values_are_rare():
    assert _least_shared(85) == 14 and _least_shared(80) == 11
