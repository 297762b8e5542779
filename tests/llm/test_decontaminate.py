import hashlib
import random
import tracemalloc

import pytest

from ledgerline.llm import decontaminate
from ledgerline.llm.decontaminate import Patterns, clean_documents, find_passages, hits, words_of
from tests.llm.brute import passages
from tests.llm.conftest import SMALL


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows += [(900, "only three words"), (901, "One"), (902, None), (903, "..."), (None, "a b c d e f g h i j k l"),
             (904, "la la la la la la la la la la la la"), (905, rows[3][1].upper())]
    return rows


def test_hits_equal_brute_force(spark, documents, benchmark):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(5000, "x " + benchmark[3][1] + " y " + benchmark[4][1]), (5001, "and one, ONLY three words"),
             (5002, "la " * 25), (5003, "a b c d e f g h i j k l m"), (5004, None), (5005, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(benchmark, "item_id long, text string")
    got = {r.doc_id: r for r in hits(find_passages(docs, table)).collect()}
    clean = {r.doc_id for r in clean_documents(docs, table).collect()}
    for i, text in rows:
        n, hit, items = passages(text, benchmark)
        names = sorted(str(x) for x in items if x is not None)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, len(hit), len(names), bool(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (i in clean) == (not hit)


def test_passes_agree_with_one(spark, documents, benchmark, monkeypatch):
    table = spark.createDataFrame(benchmark, "item_id long, text string")
    docs = documents.unionByName(documents.limit(3))
    one = sorted(map(tuple, hits(find_passages(docs, table)).collect()))
    few = sorted(r.doc_id for r in clean_documents(docs, table).collect())
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 3000)
    assert sorted(map(tuple, hits(find_passages(docs, table)).collect())) == one
    assert sorted(r.doc_id for r in clean_documents(docs, table).collect()) == few


def test_long_benchmark_texts_are_cut(spark, monkeypatch):
    """A text above the bounds is cut into pieces that hold each of its windows."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(3_000)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, "four words of item"), (3, None)], "item_id long, text string")
    docs = [(n, " ".join(["x"] * n + words[n * 29 : n * 29 + 9 + n % 3])) for n in range(100)] + [(900, " ".join(words[::-1])), (901, "four words of item x")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, hits(find_passages(rows, table)).collect()))
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2_000)
    monkeypatch.setattr(decontaminate, "CUT_BYTES", 1_500)
    assert sorted(map(tuple, hits(find_passages(rows, table)).collect())) == one
    assert {r[0] for r in one if r[-1]} == {n for n in range(100) if n % 3} | {901}


def test_tables_are_small():
    """Tables of a megabyte of benchmark with as many patterns as words take a few times that."""
    rng = random.Random(6)
    items = [(str(n), " ".join(f"w{rng.randrange(40_000)}" for _ in range(150))) for n in range(1_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    patterns = Patterns(items, 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size > 900_000 and held < 25 * size
    for item, text in items[:50]:
        spans, found = patterns.spans(words_of("before " + text + " after"))
        assert spans == [(1, 151)] and found == {item}


def test_odd_rows(spark, odd, empty, benchmark):
    table = spark.createDataFrame([(1, "six seven eight nine ten eleven twelve")], "item_id long, text string")
    found = hits(find_passages(odd, table)).collect()
    assert len(found) == odd.count() and sorted(r.doc_id for r in found if r.contaminated) == [4, 4, 5]
    kept = clean_documents(odd, table)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in hits(find_passages(odd, none)).collect())
    assert find_passages(empty, table).collect() == [] and clean_documents(empty, table).collect() == []
