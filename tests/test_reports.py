"""Labels, first errors, test logs and reports."""

import json

from pyspark.sql import functions as F

from ledgerline.operators.reports import (
    Limits, blocked_runs, event_snippet, first_error, merge_report, parse_reports, parse_test_log,
)
from ledgerline.operators.scoring import failure_hints, pass_rate_by_test, test_pass_rate as rate_of_tests

LABELS = [
    ({"type": "tool_use", "name": "edit_file", "input": {"file_path": "src/lib/core.py"}}, "edit_file core.py"),
    ({"type": "tool_call", "command": "ls  -la\n/tmp"}, "tool ls -la /tmp"),
    ({"tool_call": {"name": "grep"}, "args": {"path": "a/b/"}}, "grep b"),
    ({"type": "result", "subtype": "success"}, "cli result success"),
    ({"type": "result"}, "cli result done"),
    ({"type": "result", "is_error": True, "errors": ["bad key", "x"]}, "cli error bad key"),
    ({"type": "result", "isError": True}, "cli error is_error"),
    ({"type": "error", "message": "bang"}, "cli error bang"),
    ({"type": "Error", "message": {"error": "deep"}}, "cli error deep"),
    ({"event": "turn.failed", "status": "gone"}, "cli error gone"),
    ({"type": "error", "subtype": "x", "message": {"code": 5}}, "cli error error"),
    ({"type": "assistant", "message": {"content": "hello  there"}}, "model hello there"),
    ({"type": "assistant", "message": {"content": [{"type": "text"}, {"type": "tool_use", "name": "run", "input": {"command": "ls"}}]}}, "run ls"),
    ({"type": "x", "content": {"content": [{"type": "m", "message": {"content": [{"type": "system"}]}}]}}, "cli system"),
    ({"type": "assistant", "text": "w" * 80}, "model " + "w" * 69 + "..."),
    ({"type": "system", "subtype": "session_start"}, "cli session_start"),
    ({"type": "turn.completed"}, "cli turn.completed"),
    ({"type": "other"}, None),
    ({"type": "message", "name": "assistant", "text": "hi"}, "model hi"),
]
LINES = [
    ("", None), ("   ", None), ("- - |", None), ("\x1b[2K", None), ("z" * 401, None), (" a   b ", "a b"),
    ("{broken", None), ("[1]", None), ('[{"type":"x"},{"type":"system"}]', "cli system"), ("y" * 100, "y" * 93 + "..."),
]


def test_event_snippet(spark):
    rows = [(json.dumps(e), w) for e, w in LABELS] + LINES
    cut = event_snippet("line", Limits(said=72, target=64, line=96, noise=400))
    df = spark.createDataFrame(rows, "line string, want string").withColumns({"got": cut, "whole": event_snippet("line")})
    assert df.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    long = {r.line[:1]: r.whole for r in df.filter("length(line) >= 100").collect() if r.line[0] in "zy"}
    assert long == {"z": "z" * 401, "y": "y" * 100}


def texts(spark, items):
    return spark.createDataFrame([(*i[:2], n, i[2]) for n, i in enumerate(items)], "run_id string, stream string, seq long, text string")


def test_first_error(spark):
    j = json.dumps
    df = texts(spark, [
        ("a", "stdout", j({"type": "error", "message": "out"})),
        ("a", "stderr", "noise\n" + j({"is_error": True, "result": "err", "stop_reason": "auth"})),
        ("b", "stdout", "first\nlast  line\n\n"),
        ("b", "stderr", " \n"),
        ("c", "stderr", "warned"), ("c", "stdout", "said"),
        ("d", "stdout", j({"payload": {"type": "stream_error", "message": "cut"}})),
        ("e", "stdout", j({"type": "turn.failed", "error": {"message": "inner"}}) + "\n" + j({"type": "error", "message": "later"})),
        ("f", "stdout", j([{"type": "error", "errors": ["one", "two"]}])),
        ("g", "stdout", j({"is_error": False, "result": "fine"})),
        ("h", "stdout", '{"type":"error","message":"huge","duration_api_ms":1e999,"usage":{"input_tokens":-1e999}}'),
        ("i", "stdout", "e" * 500),
    ])
    got = {r.run_id: r.error for r in first_error(df, ["run_id"]).collect()}
    assert got == {"a": "err (auth)", "b": "last line", "c": "warned", "d": "cut", "e": "inner", "f": "one",
                   "g": j({"is_error": False, "result": "fine"}), "h": "huge", "i": "e" * 500}
    assert {r.run_id: r.error for r in first_error(df, ["run_id"], limit=220).collect()}["i"] == "e" * 217 + "..."
    named = df.withColumns({"task_id": F.lit("t"), "attempt": F.lit(1), "file": F.col("stream"), "source": F.lit("cli")})
    assert {r.run_id: r.error for r in first_error(named).collect()} == {**got}


def test_test_logs_fill_reports(spark):
    log = (
        "test_a (m.T) ... ok\ntest_b (m.T) ... FAIL\ntest_c (m.T) ... skipped 'x'\ntest_d (m.T) ... ERROR\n\n"
        "FAIL: test_b (m.T)\nAssertionError: 1 != 2\nValueError: bad \nAssertionError: 1 != 2\n"
    )
    logs = spark.createDataFrame([("r1", log), ("r2", "FAIL: test_z (m.T)\nERROR: test_y\n"), ("r3", None)], "run_id string, log string")
    parsed = parse_test_log(logs)
    got = {r.run_id: (r.passedTests, r.failedTests, r.details) for r in parsed.collect()}
    assert got == {
        "r1": (["test_a"], ["test_b", "test_d"], ["AssertionError: 1 != 2", "ValueError: bad"]),
        "r2": ([], ["test_z", "test_y"], []),
        "r3": ([], [], []),
    }
    raw = [("r1", '{"ok":false,"reward":0,"failed":2}'), ("r2", '{"ok":false,"failedTests":[],"errors":["e"]}'), ("r3", None), ("r4", "[1]")]
    reports = parse_reports(spark.createDataFrame(raw, "run_id string, text string"))
    out = {r.run_id: r for r in merge_report(reports, parsed, ["run_id"]).collect()}
    assert out["r1"].failedTests == out["r1"].errors == ["test_b", "test_d"] and out["r1"].passedTests == ["test_a"]
    assert out["r2"].failedTests == [] and out["r2"].errors == ["e"]
    assert (out["r3"].ok, out["r3"].failed, out["r3"].error) == (False, 1, "no reward.json")
    assert (out["r4"].ok, out["r4"].reward, out["r4"].failed, out["r4"].error) == (False, 0, 1, None)


def test_rates_and_hints(spark):
    rows = [("r1", True, ["a", "b"], ["c"], None), ("r2", True, None, None, None), ("r3", False, [], [], ["c", "d"]), ("r4", None, None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, ok boolean, passedTests array<string>, failedTests array<string>, errors array<string>")
    assert {r.run_id: (r.tests_passed, r.tests_total, round(r.pass_rate, 3)) for r in rate_of_tests(df).collect()} == {
        "r1": (2, 3, 0.667), "r2": (0, 0, 1.0), "r3": (0, 2, 0.0), "r4": (0, 0, 0.0)}
    assert {r.test: (r.passes, r.runs) for r in pass_rate_by_test(df).collect()} == {"a": (1, 1), "b": (1, 1), "c": (0, 2), "d": (0, 1)}
    hints = spark.createDataFrame([("c", "look at c")], "test string, hint string")
    got = {(r.run_id, r.place, r.test): r.hint for r in failure_hints(df, ["run_id"], hints, limit=1).collect()}
    assert got == {("r1", 0, "c"): "look at c", ("r3", 0, "c"): "look at c"}
    assert {r.test: r.hint for r in failure_hints(df, ["run_id"], hints).collect()}["d"].startswith("Re-read")
    named = df.withColumn("failedTests", F.array(F.lit("test_pointer_escapes"), F.lit("other")))
    assert {r.hint[:12] for r in failure_hints(named, ["run_id"]).collect()} == {"JSON Pointer", "Re-read that"}


def test_blocked_runs(spark):
    j = json.dumps
    df = texts(spark, [
        ("no tokens", "stdout", j({"is_error": True, "usage": {"input_tokens": 0}})),
        ("tokens", "stdout", j({"is_error": True, "usage": {"input_tokens": 3}})),
        ("api time", "stdout", j({"isError": True, "duration_api_ms": 12})),
        ("endless", "stdout", '{"is_error":true,"duration_api_ms":1e999}'),
        ("jail", "stderr", "sandbox-exec: denied"), ("jail ok", "stderr", "sandbox-exec: denied"), ("fine", "stdout", "done"),
    ])
    exits = spark.createDataFrame([("jail", 1), ("jail ok", 0), ("fine", 1), ("tokens", None)], "run_id string, exit_code int")
    assert {r.run_id for r in blocked_runs(df, exits, ["run_id"]).collect()} == {"no tokens", "endless", "jail"}
