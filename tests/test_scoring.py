"""Scoring, rollups and text functions on literal rows."""

import json

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.jsontext import object_entries
from ledgerline.operators.scoring import (
    attempts_run, attempts_to_pass, latest_attempt, rank_eligibility, score_outputs, unknown_tasks, values_match,
)

# expected, actual, whether they agree
VALUES = [
    (None, None, True), (None, 0, False), (0, None, False), (True, True, True), (True, 1, True), (1, True, True), (True, "true", False),
    (False, 0.0, True), (True, 1.0000001, False), (1, 1.0000005, True), (1, 1.00001, False), (1, "1", False), ("Ab ", " aB", True),
    ("é", "É", True), ("a", "b", False), ([1, True], [1.0, 1], True), ([1], [1, 2], False), ({"a": [None]}, {"a": [None]}, True),
    ({"a": 1}, {"a": 2}, False), ([], {}, False), (-3, -3.0, True), ("", "  ", True), (10**20, 10**20, True),
]


def test_values_match(spark):
    rows = [(json.dumps({"v": e}), json.dumps({"v": a}), w) for e, a, w in VALUES]
    df = spark.createDataFrame(rows, "e string, a string, want boolean")
    df = df.withColumns({"x": object_entries("e"), "y": object_entries("a")})
    bad = df.filter(values_match(F.col("x")["v"], F.col("y")["v"]) != F.col("want"))
    assert [(r.e, r.a) for r in bad.collect()] == []


def test_score_outputs(spark):
    tasks = spark.createDataFrame([("t", '{"ok":true,"failed":0}'), ("none", "{}")], "task_id string, expected string")
    outputs = [("t", '{"ok": true, "failed": 0, "more": 1}', True), ("t", '{"ok": true}', False), ("t", "```json\n{\"ok\":1,\"failed\":0.0}\n```", True),
               ("t", "nothing", False), ("t", None, False), ("none", "{}", False), ("none", '{"a":1}', True)]
    df = spark.createDataFrame([(i, *o) for i, o in enumerate([*outputs, ("gone", "{}", False)])], "i int, task_id string, output string, want boolean")
    out = score_outputs(df, tasks)
    assert out.filter("passed != want").collect() == [] and out.count() == len(outputs)
    assert [r.task_id for r in unknown_tasks(df, tasks).collect()] == ["gone"]


def test_attempts(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False), ("c", 3, True), ("c", 1, False)]
    df = spark.createDataFrame(rows, "task string, attempt int, passed boolean")
    got = lambda d: {r.task: (r.passed, r.attempts) for r in d.collect()}
    assert got(attempts_to_pass(df, ["task"])) == {"a": (True, 2), "b": (False, 2), "c": (True, 3)}
    assert got(attempts_to_pass(df, ["task"], cap=1)) == {"a": (False, 1), "b": (False, 1), "c": (False, 1)}
    assert {(r.task, r.attempt) for r in attempts_run(df, ["task"]).collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 3)}
    assert {(r.task, r.attempt, r.passed) for r in latest_attempt(df, ["task"]).collect()} == {("a", 3, True), ("b", 2, False), ("c", 3, True)}


def test_rank_eligibility(spark):
    rows = [("full", 2, 2, 5), ("part", 2, 1, 5), ("free", 2, 2, 0)]
    df = spark.createDataFrame(rows, "run_id string, tasks long, passed long, input long")
    df = df.withColumns({b: F.lit(0) for b in ("output", "reasoning", "cache_hit", "cache_write")})
    assert {r.run_id: r.rankable for r in rank_eligibility(df).collect()} == {"full": True, "part": False, "free": False}


def test_text_functions(spark):
    cases = [
        (X.slug(F.lit(" Qwen3.8-Max!! ")), "qwen3-8-max"), (X.slug(F.lit("__")), "model"), (X.slug(F.lit("Été 2")), "été-2"),
        (X.one_line(F.lit(" a \n b "), 10), "a b"), (X.one_line(F.lit("abcdefgh"), 6), "abc..."), (X.one_line(F.lit("abcdef"), 6), "abcdef"),
        (X.format_elapsed(F.lit(3723.9)), "1h02m03s"), (X.format_elapsed(F.lit(63)), "1m03s"), (X.format_elapsed(F.lit(-5)), "0s"),
        (X.normalize_text(F.lit("é\r\nx\ry")), "é\nx\ny"), (X.catalog_id(F.lit("kimi")), "hrs_kimi"), (X.catalog_id(F.lit("zz")), "hrs_custom"),
        (X.path_tail(F.lit("a/b.c/")), "b.c"), (X.file_stem(F.lit("a/b.c.json")), "b.c"), (X.file_stem(F.lit("a/.env")), ".env"),
        (X.task_tag(F.lit("x/01-alpha-b")), "alpha-b"), (X.task_tag(F.lit("x/alpha"), F.lit(" \n")), "alpha"), (X.strip(F.lit(" a b\x1f\n")), "a b"),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]
