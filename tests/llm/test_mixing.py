from collections import Counter

import pytest

from ledgerline.llm.mixing import BLOCK_WORDS, _plan, mix, mixed_documents, schedule, taken, targets
from tests.llm.brute import mix_targets


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 5000, "c": 3, "d": 900, None: 77}, {"x": 1}, {"a": 0, "b": 0},
    {"a": 0, "b": 50}, {f"s{i}": i * i for i in range(23)},
])
def test_targets_equal_rounds_of_sharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(table).collect()}
    assert got == pytest.approx({s: float(t) for s, t in mix_targets(sizes).items()})


def test_taken_words_meet_their_targets(documents):
    rows = taken(mix(documents)).collect()
    assert len(rows) == documents.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), group in by.items():
        assert sum(r.size for r in group) % size == 0 and abs(sum(r.taken for r in group) - target) < 1
    assert sorted(map(tuple, taken(mix(documents.repartition(5))).collect())) == sorted(map(tuple, rows))


def test_blocks_are_equal_and_slots_even(spark, documents):
    rows = mix(documents).where("n is not null").collect()
    words = Counter()
    for r in rows:
        words[r.n] += r.last - r.first
    assert max(words.values()) <= BLOCK_WORDS
    table = spark.createDataFrame([("a", 800_000), ("b", 900_000), ("c", 500_000)], "source string, source_size long")
    plan = _plan(table)
    slots = [r.s for r in schedule(spark, plan).orderBy("n").collect()]
    share = Counter(slots)
    assert share == {r.s: r.slots for r in plan.collect()}
    for start in range(0, len(slots) - 500, 500):  # any stretch holds the sources near their shares
        part = Counter(slots[start : start + 500])
        assert all(abs(part[s] - 500 * n / len(slots)) <= 8 for s, n in share.items())


def test_mixed_documents_are_whole(documents):
    rows = Counter(r.doc_id for r in mixed_documents(documents).collect())
    size = {r.doc_id: (r.size, r.taken) for r in taken(mix(documents)).collect()}
    assert set(rows.values()) <= {1, 2}
    assert all(rows[i] <= 2 and (rows[i] > 0) >= (t >= n > 0) for i, (n, t) in size.items())


def test_odd_rows(odd, empty):
    rows = taken(mix(odd)).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert {r.doc_id: r.size for r in rows if r.doc_id in (1, 2, 3, 6)} == {1: 0, 2: 0, 3: 0, 6: 30_000}
    got = mixed_documents(odd)
    assert got.columns == odd.columns and max(Counter(r.doc_id for r in got.collect()).values()) <= 4
    assert taken(mix(empty)).collect() == [] and mixed_documents(empty).collect() == []
