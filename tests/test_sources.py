"""Run folders and task folders read as tables; packages and usage written and read back."""

import datetime as dt
import hashlib
import io
import json
import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.functions.jsonshape import one_value, shapes
from ledgerline.functions.text import task_tag
from ledgerline.operators.decode import extract_blobs
from ledgerline.operators.manifest import hash_of_pieces, manifest, manifest_rejects, repo_chars, suite_size, work_size
from ledgerline.operators.reports import first_error, parse_reports
from ledgerline.operators.scoring import score_outputs, seal_tasks
from ledgerline.operators.usage import harvest, sum_attempts, tallies
from ledgerline.session import BATCH_BYTES
from ledgerline.sources import files as sources
from ledgerline.sources.files import (
    answers, left_out, log_line_stream, log_lines, log_texts, report_texts, session_logs, sidecars, split_lines, task_definitions, task_files,
)
from ledgerline.sources.folders import run_files
from ledgerline.sources.sinks import packages, write_packages, write_usage


def put(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def use(n):
    return json.dumps({"usage": {"input_tokens": n, "output_tokens": 1}})


def test_session_scan_and_harvest(spark, tmp_path):
    root = put(tmp_path / "runs", {
        "a/session.json": use(50), "a/notes.json": use(9000), "a/usage.json": '{"input": 20}', "a/stdout": "done", "a/stderr.log": use(3),
        "b/.cli/logs/x.jsonl": use(42) + "\n" + use(30), "b/.git/x.json": use(9000), "b/_grade/out/reward.json": use(9000),
        "b/.cli/node_modules/p.json": use(9000), "b/.cli/readme.txt": use(9000), "b/.cli/BIG.JSON": use(9000) + " " * 3000,
        "c/Rollout-1.JSONL": use(7), "d/stdout.txt": use(5),
    })
    logs = session_logs(spark, root, max_bytes=2000)
    assert {(r.run_id, r.file) for r in logs.collect()} == {
        ("a", "session.json"), ("a", "usage.json"), ("b", ".cli/logs/x.jsonl"), ("c", "Rollout-1.JSONL")}
    texts = logs.unionByName(log_texts(spark, root), allowMissingColumns=True)
    got = {r.run_id: (r.source, r.usage["input"]) for r in harvest(texts, sidecars(spark, root), ["run_id"]).collect()}
    assert got == {"a": ("session", 50), "b": ("session", 42), "c": ("session", 7), "d": ("cli", 5)}
    assert [(r.run_id, r.file) for r in left_out(spark, root, max_bytes=2000).collect()] == [("b", ".cli/BIG.JSON")]
    assert left_out(spark, root).count() == 0 and session_logs(spark, root).count() == 5


def test_hidden_files_and_folders(spark, tmp_path):
    root = put(tmp_path / "runs", {
        "r/.cli/y.json": use(1), "r/.cli/.cache/x.jsonl": use(2), "r/.cli/_z.json": use(3), "r/.session.json": use(4),
        "r/.cli/a/.b/c/.d.json": use(5), "r/.cli/.git/no.json": use(6), "r/.cli/a/_b/e.json": use(7), "s/x.txt": "no",
    })
    rows = session_logs(spark, root).collect()
    assert {r.file for r in rows} == {
        ".cli/y.json", ".cli/.cache/x.jsonl", ".cli/_z.json", ".session.json", ".cli/a/.b/c/.d.json", ".cli/a/_b/e.json"}
    assert sum(json.loads(r.text)["usage"]["input_tokens"] for r in rows) == 22 and len(rows) == 6


def test_streams_of_an_attempt(spark, tmp_path, monkeypatch):
    """Both streams are one text: turns add up over them, whether read whole or by line."""
    turns = lambda *counts: "".join(json.dumps({"type": "turn.completed", "usage": {"input_tokens": n}}) + "\n" for n in counts)
    root = put(tmp_path / "runs", {
        "r/stdout": turns(100, 50), "r/stderr.log": turns(80), "q/t/2/stdout.txt": turns(5, 6), "q/t/1/stderr": "plain",
        "q/u+%/1/stdout": "".join(f"line {i}\n" for i in range(1000)),
    })
    for texts in (log_texts(spark, root), log_lines(spark, root)):
        whole = "seq" in texts.columns and texts.count() == 5
        by_run = harvest(texts, by=["run_id"], whole=whole).collect()
        assert {r.run_id: r.usage["input"] for r in by_run} == {"r": 230, "q": 6}
        got = {(r.run_id, r.task_id, r.attempt): r.error for r in first_error(texts, whole=whole).collect()}
        assert got[("r", None, 1)].startswith("{") and got[("q", "t", 1)] == "plain" and got[("q", "u+%", 1)] == "line 999"
    monkeypatch.setattr(sources, "SPLIT_BYTES", 700)
    rows = sorted((r.seq, r.next, r.text) for r in log_lines(spark, root).filter("task_id = 'u+%'").collect())
    assert [t for _, _, t in rows] == [f"line {i}" for i in range(1000)]
    assert [n for _, n, _ in rows[:-1]] == [s for s, _, _ in rows[1:]]  # each is known to follow the one before


def test_attempts_are_harvested_apart(spark, tmp_path):
    """Two attempts of a task with all four sources each: none counts another's, and they are added after that."""
    turn = lambda *counts: "".join(json.dumps({"type": "turn.completed", "usage": {"input_tokens": n}}) + "\n" for n in counts)
    root = put(tmp_path / "runs", {
        "r/t/1/stdout": turn(100), "r/t/2/stdout": turn(200), "r/t/1/usage.json": '{"input": 150}', "r/t/2/usage.json": '{"input": 20}',
        "r/t/1/.cli/s.json": use(120), "r/t/2/.cli/s.json": use(300), "r/u/1/stdout": "nothing", "r/u/2/stderr": "nothing", "q/stdout": turn(4, 3),
        "r/u/2/deep/session.json": use(9000), "r/u/2/.git/x.json": use(9000), "q/usage.json": "no json",
    })
    homes = put(tmp_path / "homes", {"r/.x/1.json": use(7), "r/.x/2.json": use(8), "r/.x/both.json": use(6), "r/.x/before.json": use(5000), "q/.x/1.json": use(1)})
    started = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
    for name, at in (("1", -1.5), ("both", 98.5), ("2", 100), ("before", -3)):
        os.utime(f"{homes}/r/.x/{name}.json", (started.timestamp() + at,) * 2)
    attempts = spark.createDataFrame([("r", "u", 1, started), ("r", "u", 2, started + dt.timedelta(seconds=100))],
                                     "run_id string, task_id string, attempt int, started timestamp")
    home = session_logs(spark, homes, home=True, attempts=attempts)
    assert sorted((r.attempt, r.file) for r in home.collect()) == [(1, ".x/1.json"), (1, ".x/both.json"), (2, ".x/2.json"), (2, ".x/both.json")]
    texts = log_texts(spark, root).unionByName(session_logs(spark, root)).unionByName(home)
    usage = harvest(texts, sidecars(spark, root))
    got = {(r.run_id, r.task_id, r.attempt): (r.source, r.usage["input"]) for r in usage.collect()}
    assert got == {("r", "t", 1): ("sidecar", 150), ("r", "t", 2): ("session", 300), ("r", "u", 1): ("session", 8 - 1), ("r", "u", 2): ("session", 8),
                   ("q", None, 1): ("cli", 7)}
    by_lines = log_lines(spark, root).unionByName(session_logs(spark, root), allowMissingColumns=True).unionByName(home, allowMissingColumns=True)
    again = harvest(by_lines, sidecars(spark, root), whole=False)
    assert {(r.run_id, r.task_id, r.attempt): (r.source, r.usage["input"]) for r in again.collect()} == got
    assert {(r.run_id, r.task_id): r.usage["input"] for r in sum_attempts(usage).collect()} == {("r", "t"): 450, ("r", "u"): 15, ("q", None): 7}


def test_odd_names_and_bad_files(spark, tmp_path):
    """Names are no patterns and no escapes; a file or folder that cannot be read is a row."""
    names = ["a b", "%41", "#x", "{y}", "[z]", "q?", "é*", "+"]
    root = put(tmp_path / "r%u n#s", {f"run {n}/t {n}/1/.h {n}/.c {n}.json": use(i) for i, n in enumerate(names)} | {f"run {n}/stdout": n for n in names})
    logs = session_logs(spark, root)
    assert {r.run_id[4:]: (r.task_id, json.loads(r.text)["usage"]["input_tokens"]) for r in logs.collect()} == {n: (f"t {n}", i) for i, n in enumerate(names)}
    assert {r.run_id: r.text for r in log_lines(spark, root).collect()} == {f"run {n}": n for n in names}
    bad = tmp_path / "bad"
    put(bad, {"r/.c/good.json": use(3), "r/.c/gone.json": use(4), "r/stdout": "x\n"})
    kept = session_logs(spark, str(bad))  # listed now, opened later
    (bad / "r" / ".c" / "gone.json").unlink()
    rows = {r.file: (r.text is None, r.error is not None) for r in kept.collect()}
    assert rows == {".c/good.json": (False, False), ".c/gone.json": (True, True)}
    lines = log_lines(spark, str(bad))
    (bad / "r" / "stdout").unlink()
    assert [(r.seq, r.text, r.error is not None) for r in lines.collect()] == [(None, None, True)]
    assert harvest(kept.unionByName(lines, allowMissingColumns=True), whole=False).first().usage["input"] == 3


def test_other_stores(spark, tmp_path):
    """A mount that only Hadoop knows is resolved to what it stands for."""
    put(tmp_path / "runs", {"r/stdout": "one\ntwo"})
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.ledger.link./in", f"file://{tmp_path}")
    root = "viewfs://ledger/in/runs"
    assert sorted(r.text for r in log_lines(spark, root).collect()) == ["one", "two"]
    assert log_texts(spark, root).first().text == "one\ntwo" and log_texts(spark, "viewfs://ledger/in/none").collect() == []
    store, found = run_files(spark, root)
    assert store == "" and found.first().file == "stdout"


def test_values_over_many_splits(spark, tmp_path, monkeypatch):
    """A stream that is one JSON value is one, however its lines and splits fall; others are lines."""
    monkeypatch.setattr(sources, "SPLIT_BYTES", 64)
    big = json.dumps({"note": 'quotes " and \\ and } here ' * 9, "type": "result", "usage": {"input_tokens": 77, "x": [{}, []]}}, indent=3)
    listed = json.dumps([{"type": "turn.completed", "usage": {"input_tokens": n}, "pad": "p" * 40} for n in (9, 5, 3)], indent=1)
    turns = "".join(json.dumps({"type": "turn.completed", "usage": {"input_tokens": n}}) + "\n" for n in (4, 9, 2))
    files = {
        "big/stdout": big + "\n\n  ", "list/t/2/stdout": "\n " + listed, "lines/stdout": turns, "plain/stderr": "{ not json\n" + turns,
        "two/stdout": big + "\n" + big, "cut/stdout": big[:-2], "tail/stdout": big + "\nend", "empty/stdout": "", "open/stdout": "{\n" * 30,
        "one/stdout": big.replace("\n", " "), "closed/stdout": big + "}", "blank/stdout": "\n" * 500,
    }
    root = put(tmp_path / "runs", files)
    got = log_lines(spark, root)
    assert {r.run_id for r in got.filter("whole").collect()} == {"big", "list"}
    assert {r.text for r in got.filter("run_id = 'big'").collect()} == {files["big/stdout"]}
    by_lines = {(r.run_id, r.attempt): r.usage["input"] for r in harvest(got, whole=False).collect()}
    assert by_lines == {(r.run_id, r.attempt): r.usage["input"] for r in harvest(log_texts(spark, root)).collect()}
    assert by_lines[("big", 1)] == 77 and by_lines[("list", 2)] == 17 and by_lines[("lines", 1)] == 15 and ("cut", 1) not in by_lines


def test_shape_of_pieces():
    """Cut anywhere, a text is one value or not as it is in one piece; and as a plain scan says."""
    def plain(text):
        depth, inside, k, text = 0, False, 0, text.strip()
        while k < len(text):
            c = text[k]
            if inside:
                k += c == "\\"
                inside = c != '"'
            elif c == '"':
                inside = True
            elif c in "{[":
                depth += 1
            elif c in "]}":
                depth -= 1
                if depth < 1:
                    return depth == 0 and k == len(text) - 1
            k += 1
        return False

    rng = random.Random(3)
    for _ in range(2_000):
        text = "{" + "".join(rng.choice('{}[]"\\ a\n') for _ in range(rng.randrange(14))) + rng.choice(["}", "} ", '"}', "]\n \n", ""])
        data = text.encode()
        for size in (1, 2, 5, 100):
            pieces = [(not p.strip(), shapes(p, not n)) for n in range(0, len(data), size) for p in [data[n : n + size]]]
            assert one_value(pieces) == plain(text), (text, size)


def test_lines_of_splits():
    """Every line once, whatever the borders, line ends and gaps; places are the bytes they begin at."""
    rng = random.Random(4)
    for _ in range(300):
        data = "".join(rng.choice(["a", "bc", "\n", "\r\n", "\r", "é"]) for _ in range(rng.randrange(40))).encode()
        size = rng.randrange(1, 12)
        got = [x for start in range(0, max(len(data), 1), size) for x in split_lines(io.BytesIO(data), start, min(start + size, len(data)))]
        assert [x for _, x in got] == data.splitlines(keepends=True) and b"".join(x for _, x in got) == data
        assert [p for p, _ in got] == [sum(map(len, data.splitlines(True)[:n])) for n in range(len(got))]


def test_stream_of_a_growing_file(spark, tmp_path):
    """A file that grew is read again with the same places; one that did not is not."""
    root = put(tmp_path / "runs", {"r/t/2/stdout": "one\ntwo\n", "r/t/2/stderr": "bad\n"})
    out = str(tmp_path / "out")

    def more():
        lines = log_line_stream(spark, root, settle_ms=0)
        lines.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return sorted((r.stream, r.seq, r.text) for r in spark.read.parquet(out).collect())

    assert more() == [("stderr", 0, "bad"), ("stdout", 0, "one"), ("stdout", 4, "two")]
    put(tmp_path / "runs", {"r/t/2/stdout": "one\ntwo\nthree\n"})
    assert more() == sorted([("stderr", 0, "bad"), *[("stdout", 0, "one"), ("stdout", 4, "two")] * 2, ("stdout", 8, "three")])
    assert len(more()) == 6


def test_file_cap_and_home_scan(spark, tmp_path):
    root = put(tmp_path / "runs", {f"r/.cli/{i:02}.json": use(i) for i in range(6)} | {"r/session.json": use(1), "q/.x/1.json": use(2)})
    got = {(r.run_id, r.file) for r in session_logs(spark, root, max_files=3).collect()}
    assert got == {("r", "session.json"), ("r", ".cli/00.json"), ("r", ".cli/01.json"), ("q", ".x/1.json")}
    home = put(tmp_path / "home", {
        "u/.new/s/l.jsonl": use(7), "u/.new/1/2/3/4/ok.json": use(1), "u/.new/1/2/3/4/5/deep.json": use(1), "u/session.json": use(1)})
    now = dt.datetime.now()
    recent = session_logs(spark, home, since=now - dt.timedelta(hours=1), home=True, max_depth=4)
    assert {r.file for r in recent.collect()} == {".new/s/l.jsonl", ".new/1/2/3/4/ok.json"}
    assert session_logs(spark, home, since=now - dt.timedelta(hours=1), home=True).count() == 3
    assert session_logs(spark, home, since=now + dt.timedelta(hours=1), home=True).count() == 0
    assert session_logs(spark, str(tmp_path / "none")).count() == 0


def test_reports_and_answers(spark, tmp_path):
    root = put(tmp_path, {"a/reward.json": '{"ok":true,"reward":1,"failed":0}', "a/answer.json": "A", "a/out.json": "O", "b/out.json": "O"})
    put(tmp_path, {"a/t/2/reward.json": '{"ok":true,"reward":2,"failed":0}', "a/t/2/out.json": "T", "a/t/1/.x/answer.json": "no"})
    each = spark.createDataFrame([("a", "t", 1), ("a", "t", 2), ("a", None, 1)], "run_id string, task_id string, attempt int")
    assert {(r.task_id, r.attempt): r.output for r in answers(spark, root, each).collect()} == {("t", 1): "", ("t", 2): "T", (None, 1): "A"}
    assert {(r.task_id, r.attempt): r.text is None for r in report_texts(spark, root, each).collect()} == {
        ("t", 1): True, ("t", 2): False, (None, 1): False}
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    assert {r.run_id: (r.ok, r.error) for r in parse_reports(report_texts(spark, root, runs)).collect()} == {
        "a": (True, None), "b": (False, "no reward.json"), "c": (False, "no reward.json")}
    assert {r.run_id: r.output for r in answers(spark, root, runs).collect()} == {"a": "A", "b": "O", "c": ""}


def test_task_folders(spark, tmp_path):
    root = put(tmp_path, {
        "01-alpha/instruction.md": "Do é\r\nit", "01-alpha/expected.json": '{ "ok": true, "failed": 0 }', "01-alpha/id.txt": "al\n",
        "01-alpha/environment/repo/a.py": "xx", "01-alpha/environment/repo/t/b.py": "y\r\nz", "01-alpha/environment/repo/bin": b"\xff\xfe",
        "03-gamma/expected.json": "{}", "02-beta/instruction.md": "B", "02-beta/expected.json": "{}", "02-beta/label.txt": " Beta \n", "02-beta/extra.txt": "no",
    })
    tasks = task_definitions(spark, root)
    rows = {r.task_folder: (r.task_id, r.label, r.instruction) for r in tasks.collect()}
    assert rows == {"01-alpha": ("al", "01-alpha", "Do é\nit"), "02-beta": ("beta", "Beta", "B")}
    files = task_files(spark, root)
    assert {(r.task_folder, r.path) for r in files.collect()} == {("01-alpha", "a.py"), ("01-alpha", "t/b.py")}
    sized = work_size(tasks.drop("task_id").withColumnRenamed("task_folder", "task_id"),
                      repo_chars(files.withColumnRenamed("task_folder", "task_id")))
    # 7 + 22 + (2 + 1 + 3), and 1 + 2
    assert {r.task_id: r.work_chars for r in sized.collect()} == {"01-alpha": 35, "02-beta": 3}
    total = suite_size(sized).first()
    assert (total.work_chars, total.work_units) == (38, 9.5)
    suite = manifest(sized.withColumn("suite", F.lit("s")), ["suite"]).first()
    body = [{"id": i, "promptHash": hashlib.sha256(p.encode()).hexdigest(), "check": "extract-json", "expectedKeys": sorted(e),
             "expectedJson": e, "mustInclude": None} for i, p, e in (("01-alpha", "Do é\nit", {"ok": True, "failed": 0}), ("02-beta", "B", {}))]
    assert suite.suite_hash == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert (suite.tasks, suite.work_chars) == (2, 38)
    bad = sized.unionByName(sized.limit(1).withColumns({"task_id": F.lit("zz"), "expected": F.lit('{"a":')})).withColumn("suite", F.lit("s"))
    assert manifest(bad, ["suite"]).first().suite_hash == suite.suite_hash
    assert [r.task_id for r in manifest_rejects(bad, ["suite"]).collect()] == ["zz"]
    blank = spark.createDataFrame([("x/01-alpha", " \n"), ("x/01-alpha", None), ("x/01-alpha", "id")], "f string, i string")
    assert [r.t for r in blank.select(task_tag("f", "i").alias("t")).collect()] == ["01-alpha", "alpha", "id"]


def test_packages_and_usage_round_trip(spark, tmp_path):
    usage = "struct<input: long, output: long, reasoning: long, cache_hit: long, cache_write: long>"
    raw = spark.createDataFrame(
        [("r1", "t1", '{"ok": true}', (5, 2, 0, 0, 0), 2, "cli"), ("r1", "t2", "nope", None, None, None), ("r2", "t1", "ok", (1, 1, 0, 0, 0), 0, "cli"),
         ("r1", "unheard", "{}", None, 1, None)],
        f"run_id string, task_id string, output string, usage {usage}, attempts int, provider_source string")
    tasks = spark.createDataFrame([("t1", "h1", '{"ok":1}'), ("t2", "h2", '{"ok":true}')], "task_id string, prompt_hash string, expected string")
    sealed = seal_tasks(raw, tasks)
    runs = spark.createDataFrame([("r1", "s", "f", ("Big Model 3", "qwen", "max")), ("r2", "s", "f", ("m", "pi", "low"))],
                                 "run_id string, started_at string, finished_at string, stack struct<modelSlug: string, harnessSlug: string, setting: string>")
    suite = dict(format="f/1", evaluator="e", evaluatorVersion="1", suiteVersion="v", suiteHash="h")
    packed = packages(sealed, runs, suite)
    rows = packed.filter("run_id = 'r1'").orderBy("part", "task_id").collect()
    assert {r.name for r in rows} == {"big-model-3-qwen-max"}
    package = json.loads("".join(r.piece for r in rows))
    assert package["totals"] == {"tasks": 2, "passed": 1, "input": 5, "output": 2, "reasoning": 0, "cacheHit": 0, "cacheWrite": 0}
    first, second = package["run"]["tasks"]
    assert first["passed"] and first["attempts"] == 2 and first["providerUsage"] == {"source": "cli"}
    assert not second["passed"] and second["attempts"] == 1 and second["providerUsage"] is None
    bare = {k: v for k, v in package.items() if k != "integrity"}
    assert package["integrity"] == hashlib.sha256(json.dumps(bare, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    turned = packages(sealed.withColumn("nth", F.when(F.col("task_id") == "t1", 2).otherwise(1)), runs, suite, order="nth")
    other = json.loads("".join(r.piece for r in turned.filter("run_id = 'r1'").orderBy("part", "place").collect()))
    assert [t["id"] for t in other["run"]["tasks"]] == ["t2", "t1"] and other["integrity"] != package["integrity"]
    bare = {k: v for k, v in other.items() if k != "integrity"}
    assert other["integrity"] == hashlib.sha256(json.dumps(bare, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    write_packages(packed, str(tmp_path / "out"))
    (written,) = (tmp_path / "out" / "run_id=r1" / "name=big-model-3-qwen-max").glob("*.txt")
    assert json.loads(written.read_text()) == package
    write_usage(sealed, str(tmp_path / "usage"), ["run_id"])
    back = spark.read.json(str(tmp_path / "usage"))
    assert {"input", "output", "reasoning", "cacheHit", "cacheWrite", "run_id"} == set(back.columns) and back.count() == 3


def test_long_texts_go_to_python_a_few_at_a_time(spark):
    """What a worker is given does not grow with the table, whatever the session said before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(300).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), F.lit("stdout").alias("stream"), F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = lambda: [r.n for r in texts.coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    docs = texts.select("run_id", F.col("seq").alias("task_id"), F.col("text").alias("output"))
    tasks = spark.createDataFrame([(1, "{}")], "task_id long, expected string")
    uses = (lambda: score_outputs(docs, tasks), lambda: hash_of_pieces(texts, ["run_id"], ["seq"], "text"), lambda: tallies(texts, ["run_id"]),
            lambda: extract_blobs(texts, ["seq"]))
    try:
        for use in uses:
            spark.conf.set(name, str(64 << 20))
            use()
            assert max(sizes()) <= BATCH_BYTES + 200_000
    finally:
        spark.conf.set(name, str(BATCH_BYTES))
