import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.quality import _quantile, accepted_documents, judge, perplexities, probabilities, train, trusted_keys
from tests.llm.brute import kneser_ney, perplexity
from tests.llm.conftest import SMALL


@pytest.mark.parametrize("order", [2, 4])
def test_perplexities_equal_the_definition(spark, documents, order):
    docs = documents.orderBy("doc_id").limit(40)
    trusted = docs.where("doc_id % 3 = 0")
    p = kneser_ney([r.text for r in trusted.collect()], order)
    table, found = train(trusted, order=order)
    got = perplexities(docs, table, found, key="doc_id", text="text", lang="lang", order=order).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got[:15]:
        assert r.perplexity == pytest.approx(perplexity(p, texts[r.key], order), rel=1e-4)


def test_probabilities_add_up_to_one(spark, documents):
    table, found = train(documents.limit(20), order=3)
    letters = sorted({c for r in documents.limit(20).collect() for c in " ".join(r.text.split())})
    grams = spark.createDataFrame([(ctx + c,) for ctx in ("th", "zq", "~~") for c in letters], "gram string")
    total = {}
    for r in probabilities(grams, table, found, 3).collect():
        total[r.gram[:2]] = total.get(r.gram[:2], 0) + 2.718281828459045**r.logp
    # one share of the uniform part is kept for unknown letters
    assert all(0.98 < t <= 1.0001 for t in total.values())


def test_labels_and_keeps(spark):
    small = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    found = {r.doc_id: r for r in judge(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [found[i].accepted for i, q in truth.items() if q == 1 and i in found]
    bad = [found[i].accepted for i, q in truth.items() if q == 0 and i in found]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.4 * len(bad)
    kept = accepted_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in found.values())


def test_junk_of_every_length_is_rejected(spark):
    small = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    found = {r.doc_id: r for r in judge(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    bad = [found[i].accepted for i, q in truth.items() if q == 0 and i in found]
    assert sum(bad) <= 0.05 * len(bad)
    assert all(r.accepted == (r.perplexity <= r.threshold) for r in found.values() if r.perplexity is not None)


def test_all_trusted_rows_count(spark, documents, monkeypatch):
    many = spark.range(200_500).selectExpr("id as doc_id", "1 as quality")
    assert trusted_keys(many).count() == 200_500
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    sent = sorted(judge(documents, labels).collect(), key=str)
    monkeypatch.setattr("ledgerline.llm.quality.BROADCAST_IDS", 0)
    assert sorted(judge(documents, labels).collect(), key=str) == sent
    assert accepted_documents(documents, labels).count() == sum(r.accepted for r in sent)


def test_verdicts_do_not_depend_on_partitions(spark):
    small = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    one, other = (sorted(map(tuple, judge(docs.repartition(n), labels).collect()), key=str) for n in (1, 13))
    assert one == other


def test_low_orders_by_shuffle(spark, documents, monkeypatch):
    docs = documents.limit(30)
    table, found = train(docs)
    grams = docs.select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i"), "text").select(F.substr("text", F.col("i"), F.lit(4)).alias("gram"))
    grams = grams.where("length(gram) = 4").distinct()
    sent = {r.gram: r.logp for r in probabilities(grams, table, found).collect()}
    monkeypatch.setattr("ledgerline.llm.quality.BROADCAST_GRAMS", 10)
    assert {r.gram: r.logp for r in probabilities(grams, table, found).collect()} == sent and len(sent) > 300


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.gauss(0, 5)) for _ in range(500)]
    got = {r.k: r.q for r in _quantile(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", 0.9, "q").collect()}
    for k, q in got.items():
        values = sorted(v for x, v in rows if x == k)
        assert 0 <= q - values[math.ceil(0.9 * len(values)) - 1] <= 1e-4
    assert len(got) == 3


def test_odd_rows(odd, empty, labels, no_labels):
    found = judge(odd, labels).collect()
    assert len(found) == odd.count() and all(r.accepted for r in found if r.doc_id in (1, 2, 3, 7))
    assert {r.perplexity for r in found if r.doc_id in (1, 2, 3, 7)} == {None}
    assert accepted_documents(odd, labels).columns == odd.columns
    assert all(r.accepted for r in judge(odd, no_labels).collect())
    assert judge(empty, labels).collect() == [] and accepted_documents(empty, no_labels).collect() == []
    assert [r[0] for r in trusted_keys(labels, rows=2).orderBy("__id").collect()] != []
