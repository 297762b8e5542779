"""JSON patches: restated scenarios, and a long log on one document over many chunks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.jsontext import canonical_json, extract_json_object, json_at
from ledgerline.operators.patch import _flat, apply_folded, apply_patches, flat_patches


def op(kind, path, value=None):
    return kind, path, json.dumps(value)


CASES = {
    "escapes": ({"a/b": {"~": 1}}, [op("replace", "/a~1b/~0", 7)], {"a/b": {"~": 7}}),
    "escape order": ({}, [op("add", "/~01", 1)], {"~1": 1}),
    "insert shifts": ({"xs": ["a", "c"]}, [op("add", "/xs/1", "b")], {"xs": ["a", "b", "c"]}),
    "append": ({"xs": []}, [op("add", "/xs/-", 1), op("add", "/xs/1", 2)], {"xs": [1, 2]}),
    "remove index": ({"xs": [1, 2, 3]}, [op("remove", "/xs/1")], {"xs": [1, 3]}),
    "root": ({"old": True}, [op("replace", "", [1, 2])], [1, 2]),
    "test equal across number types": ({"a": 1}, [op("test", "/a", 1.0), op("test", "/a", True)], {"a": 1}),
    "set in order": ({}, [op("add", "/a", {}), op("add", "/a/b", 1), op("replace", "/a/b", 2)], {"a": {"b": 2}}),
    "no ops": ({"k": [None]}, [], {"k": [None]}),
    "missing parent": ({}, [op("add", "/a/b", 1)], None),
    "replace missing": ({}, [op("replace", "/a", 1)], None),
    "replace append": ({"xs": [1]}, [op("replace", "/xs/-", 1)], None),
    "remove root": ({}, [op("remove", "")], None),
    "remove past end": ({"xs": [1]}, [op("remove", "/xs/1")], None),
    "bad index": ({"xs": [1]}, [op("add", "/xs/01", 1)], None),
    "failed test": ({"a": 1}, [op("add", "/b", 1), op("test", "/a", 2)], None),
    "unsupported": ({"a": 1}, [op("move", "/a")], None),
    "no slash": ({"a": 1}, [op("add", "a", 1)], None),
    "no path": ({"a": 1}, [("add", None, "1")], None),
    "walk into a number": ({"a": 1}, [op("test", "/a/b", 1)], None),
}


def test_cases(spark):
    docs = spark.createDataFrame([(n, json.dumps(d)) for n, (d, _, _) in CASES.items()], "doc_id string, doc string")
    ops = [(n, i, *o) for n, (_, os, _) in CASES.items() for i, o in enumerate(os)]
    good, bad = apply_patches(docs, spark.createDataFrame(ops, "doc_id string, seq long, op string, path string, value string"))
    assert {r.doc_id: json.loads(r.doc) for r in good.collect()} == {n: w for n, (_, _, w) in CASES.items() if w is not None}
    assert {r.doc_id for r in bad.collect()} == {n for n, (_, _, w) in CASES.items() if w is None}


@pytest.mark.parametrize("max_rows", [10**6, 60])
def test_long_log_on_one_document(spark, max_rows):
    docs = spark.createDataFrame([(1, '{"n":[]}'), (2, "{}")], "doc_id long, doc string")
    ops = [(1, i, *op("add", f"/n/{i // 2}", i)) for i in range(200)] + [(2, 0, *op("add", "/a", 1)), (3, 0, *op("add", "/a", 1))]
    want = []
    for i in range(200):
        want.insert(i // 2, i)
    df = spark.createDataFrame(ops, "doc_id long, seq long, op string, path string, value string").repartition(4)
    good, bad = apply_patches(docs, df, max_rows=max_rows)
    assert {r.doc_id: json.loads(r.doc) for r in good.collect()} == {1: {"n": want}, 2: {"a": 1}}
    assert [r.doc_id for r in bad.collect()] == [3]


def test_json_functions(spark):
    rows = [
        ('{"b":1,"a":[1.50,"é"]}', "/a/1", '{"a":[1.5,"\\u00e9"],"b":1}', '"\\u00e9"'),
        ('[{"x":null}]', "/0/x", '[{"x":null}]', "null"),
        ("{}", "/none", "{}", None),
        ("{broken", "", None, None),
    ]
    df = spark.createDataFrame(rows, "t string, p string, canon string, at string")
    out = df.filter(~canonical_json("t").eqNullSafe(F.col("canon")) | ~json_at("t", F.col("p")).eqNullSafe(F.col("at")))
    assert out.collect() == []


def test_extract_json_object(spark):
    rows = [
        ('{"a":1}', {"a": 1}), ('x\n```json\n{"a":2}\n```\n{"a":3}', {"a": 2}), ('```\nnope\n``` {"b":1} end', {"b": 1}),
        ("[1]", None), ('so {"a":{"b":1}} ok', {"a": {"b": 1}}), ("} {", None), ("", None), ('[{"a":1}]', {"a": 1}),
        ('{"a":1} {"b":2}', None),
    ]
    df = spark.createDataFrame([(t, json.dumps(w) if w else None) for t, w in rows], "t string, want string")
    bad = df.filter(~canonical_json(extract_json_object("t")).eqNullSafe(canonical_json("want"))).collect()
    assert bad == []


def test_flat_documents_need_no_fold(spark):
    """Last writers by an aggregate without Python, the same texts and errors as the fold's."""
    rng = random.Random(12)
    values = [1, -3, 0, 1.5, 0.25, -7.125, True, None, "x y", "", 10**30, "it's"]
    odd = [[1], {"a": 1}, "q\"t", "é", 1e300, 0.1 + 0.2]
    keys = ["a", "b", "c d", "", "e.f", "0"]
    docs, ops = [], []
    for n in range(300):
        doc = {k: rng.choice(values) for k in rng.sample(keys, rng.randrange(5))}
        if n % 7 == 0:
            doc[rng.choice(["a", "x/y", "ü"])] = rng.choice(odd)
        docs.append((n, json.dumps(doc, separators=rng.choice([(", ", ": "), (",", ":")]))))
        for i in range(rng.choice([0, 1, 3, 12])):
            kind = rng.choice(["add", "add", "add", "replace", "replace"]) if n % 5 else rng.choice(["add", "replace", "remove", "test"])
            value = json.dumps(rng.choice(values if n % 3 else values + odd))
            ops.append((n, i, kind, "/" + rng.choice(keys + (["a/b", "x~1y"] if n % 4 == 0 else [])), value if rng.random() < 0.9 else None))
    docs += [(900, None), (901, "[1]"), (902, "{broken"), (903, '{"a": 1, "a": 2}'), (904, "{}")]
    ops += [(999, 0, "add", "/a", "1"), (904, 0, None, "/a", "1"), (904, 1, "add", None, "1")]
    rng.shuffle(ops)
    d = spark.createDataFrame(docs, "doc_id long, doc string")
    o = spark.createDataFrame(ops, "doc_id long, seq long, op string, path string, value string").repartition(5)
    got, want = apply_patches(d.filter("doc is not null"), o), apply_folded(d.filter("doc is not null"), o)
    for one, other in zip(got, want):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    native = flat_patches(d, o)
    told = {r.doc_id for r in native.filter("plain").collect()}
    assert 50 < len(told) < 300 and "Python" not in native._jdf.queryExecution().toString() and "Arrow" not in native._jdf.queryExecution().toString()
    flat = d.select("doc_id", _flat(F.col("doc")).alias("flat"))
    assert [r.flat for r in flat.filter("doc_id >= 900").orderBy("doc_id").collect()] == [False, False, False, False, True]
