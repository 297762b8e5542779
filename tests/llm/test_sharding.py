from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.sharding import shards, write_shards
from tests.llm.brute import shard_of


@pytest.mark.parametrize("limit", [3_000, 20_000, 200_000, 10**9])
def test_shards_equal_recursive_splitting(documents, limit):
    rows = shards(documents, limit=limit).collect()
    want = shard_of([(r.doc_id, len(r.text.encode())) for r in documents.collect()], limit)
    assert {r.doc_id: r.shard for r in rows} == want
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
    assert all(r.shard_bytes == total[r.shard] and r.depth == len(r.shard) for r in rows)


def test_rows_of_one_key_overflow(spark):
    docs = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("x" * 100).alias("text")).repartition(6)
    rows = shards(docs, limit=5_000).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
    assert len(rows) == 500 and 10 <= len(total) <= 12 and max(total.values()) <= 5_000
    assert all(total[r.shard] == r.shard_bytes for r in rows)


def test_odd_rows_and_files(odd, empty, tmp_path):
    found = shards(odd, limit=1000)
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    assert {r.doc_id: r.n_bytes for r in found.collect() if r.doc_id in (1, 2, 6)} == {1: 0, 2: 0, 6: 150_000}
    assert shards(empty).collect() == []
    write_shards(found, str(tmp_path / "out"))
    assert found.sparkSession.read.parquet(str(tmp_path / "out")).count() == odd.count()
