from collections import Counter

import corpus_pipeline
from ledgerline.llm.quality import judge
from tests.llm.brute import near_components, passages, shard_of
from tests.llm.conftest import SMALL


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = [(r.doc_id, r.text) for r in before.collect()], [r.doc_id for r in docs.collect()]
        if name != "sharding":
            assert docs.columns == columns
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in judge(source, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.accepted}
    assert sorted(steps["quality"][1]) == sorted(good)
    rows, kept = steps["near_duplicates"]
    assert sorted(kept) == sorted(set(near_components(rows, 5, 80).values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows, kept = steps["decontamination"]
    assert sorted(kept) == sorted(i for i, t in rows if not passages(t, items)[1])
    rows, kept = steps["mixing"]
    assert set(Counter(kept).values()) <= {1, 2} and set(kept) <= {i for i, _ in rows}
    rows, kept = steps["sharding"]
    want = shard_of(list({i: (i, len(t.encode())) for i, t in rows}.values()), 32 << 20)
    assert {r.doc_id: r.shard for r in docs.collect()} == want and sorted(kept) == sorted(i for i, _ in rows)


def test_empty_and_odd_documents(spark, odd, empty):
    # the benchmark and labels are read from the tables, documents are given
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            assert set(start.columns) <= set(docs.columns), name
        assert docs.count() <= 2 * start.count()


def test_run_gives_shards(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "shard", "depth", "n_bytes", "shard_bytes"} <= set(found.columns) and found.count() > 100
