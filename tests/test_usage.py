"""Usage out of log text: dialects, messy streams, sources and precedence."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import fixed_values as V
from ledgerline.functions.keys import BUCKETS, bucket_of, classify_key
from ledgerline.operators import tally
from ledgerline.operators.decode import extract_blobs
from ledgerline.operators.usage import harvest, harvest_texts, read_nodes, best_usage, sum_attempts, tallies
from ledgerline.session import shared_folder


def lines(*objs):
    return "\n".join(json.dumps(o) for o in objs)


def turn(i, o, **more):
    return {"type": "turn.completed", "usage": {"input_tokens": i, "output_tokens": o}, **more}


def delta(scope, n):
    return {"kind": "usage_record", "type": "usage_record", "scope": scope, "tokenStats": {"promptTokens": n, "storedCacheTokens": 2}}


# Scenarios made from the rules: text -> input, output, reasoning, cache_hit, cache_write (None: no usage)
SHAPES = {
    "three lifetimes of one write": (
        json.dumps({"usage": {"prompt": 4, "cacheDetails": {"ephemeral_a": 10, "ephemeral_b": 20, "ephemeral_c": 3}}}), (4, 0, 0, 0, 33)),
    "one lifetime is the write itself": (json.dumps({"prompt": 4, "ephemeral_a": 10}), (4, 0, 0, 0, 10)),
    "a lone total of lifetimes is none": (json.dumps({"prompt": 4, "ephemeral_total": 10}), (4, 0, 0, 0, 0)),
    "level turns never fall": (lines(turn(8, 5), turn(8, 2), turn(8, 9)), (8, 9, 0, 0, 0)),
    "a dip in the middle adds all": (lines(turn(8, 1), turn(3, 1), turn(90, 1)), (101, 3, 0, 0, 0)),
    "a payload without info": (json.dumps({"payload": {"type": "session", "tokenCount": {"input": 61, "completion": 17}}}), (61, 17, 0, 0, 0)),
    "an empty info": (json.dumps({"payload": {"info": {}, "input": 5, "thinking": 2}}), (5, 0, 2, 0, 0)),
    "a wrapper in a part": (lines({"type": "step-complete", "part": {"usageMetadata": {"prompt": 14, "cacheStore": 6}}}), (14, 0, 0, 0, 6)),
    "own counts before those beside": (json.dumps({"input": 2, "message": {"usage": {"input": 900}}}), (900, 0, 0, 0, 0)),
    "three models, one plain": (
        json.dumps({"modelStats": {"x": {"tokens": {"prompt": 10}}, "y": {"prompt": 20, "output": 4}, "z": {"tokens": {"thoughts": 7}}}}),
        (30, 4, 7, 0, 0)),
    "an empty group before a full one": (
        json.dumps({"models": {"x": {"note": 1.5}}, "modelUsage": {"y": {"input": 6}, "z": {"input": 5}}}), (11, 0, 0, 0, 0)),
    "deltas before totals of one family": (lines(delta("delta", 40), delta("overall", 700), delta("item", 30)), (70, 0, 0, 0, 4)),
    "the richer session": (
        lines({"type": "final", "usage": {"input": 70, "output": 1}}, {"type": "agent_end", "usage": {"input": 20, "reasoned": 90}}), (20, 0, 90, 0, 0)),
    "the group is thinner": (
        json.dumps({"tokens": {"prompt": 50, "generatedTokens": 6, "cacheCreated": 8}, "modelstats": {"q": {"prompt": 50, "completion": 6}}}),
        (50, 6, 0, 0, 8)),
    "data lines between comments": (': hello\ndata: {"input": 3}\n\n: bye\ndata: {"output": 50}\n', (0, 50, 0, 0, 0)),
    "two values on a line": ('00:01 {"input": 6} then {"input": 2, "thoughts": 9} end', (2, 0, 9, 0, 0)),
    "words only": ("compiled 12 files\n3 tokens left", None),
    "flags and costs": ('{"ok": false, "reward": 3, "total_cost": 9, "elapsed_ms": 40, "request_id": 7}', None),
    "letters in any case": (json.dumps({"PROMPT": 7, "Completion": 2, "ThoughtS": 3}), (7, 2, 3, 0, 0)),
    "boxed counts": (json.dumps({"prompt": {"amount": 8}, "completion": {"n": 3}}), (8, 3, 0, 0, 0)),
    "a list of ids for the output": (json.dumps({"output": [11, 12], "prompt": 1}), (1, 2, 0, 0, 0)),
    "a list of names is no count": (json.dumps({"output": ["a", "b"], "prompt": 1}), (1, 0, 0, 0, 0)),
    "zero": (json.dumps({"prompt": 0, "output": "0"}), None),
    "spread over lines": (json.dumps({"usage": {"prompt": 21, "candidates": 4}, "x": [1, {}]}, indent=1), (21, 4, 0, 0, 0)),
    "whole list": (json.dumps([turn(50, 1), turn(9, 1)]), (59, 2, 0, 0, 0)),
    "coercion": (json.dumps({"prompt": "42", "output": 3.0, "reasoning": True, "cached": -5, "cacheWrite": 1.5}), (42, 3, 0, 0, 0)),
    "beyond 64 bits": ('{"prompt": 99999999999999999999, "output": "123456789012345678901234", "thoughts": 1e999}', (2**63 - 1, 2**63 - 1, 0, 0, 0)),
    "sums beyond 64 bits": (lines(turn(2**63 - 1, 1), turn(2**62, 1)), (2**63 - 1, 2, 0, 0, 0)),
    "last duplicate key": ('{"input":1,"input":9,"output":2}', (9, 2, 0, 0, 0)),
    "truncated": ('{"input": 5, "output": 1} {"input": 70, "out', (5, 1, 0, 0, 0)),
    "surrogate in a label": ('{"type":"\\ud800","input":5,"output":2}', (5, 2, 0, 0, 0)),
    "zero-sized first usage object": (json.dumps({"usage": {"x": 1}, "tokens": {"input": 4, "output": 1}}), (4, 1, 0, 0, 0)),
}


def text_rows(spark, items):
    rows = [(str(r), "t", 1, source, file, stream, seq, text) for r, source, file, stream, seq, text in items]
    return spark.createDataFrame(
        rows, "run_id string, task_id string, attempt int, source string, file string, stream string, seq long, text string"
    )


def five(usage):
    return tuple(usage[b] for b in BUCKETS)


def test_shapes(spark):
    texts = text_rows(spark, [(name, "cli", "", "stdout", 0, text) for name, (text, _) in SHAPES.items()])
    got = {r.run_id: five(r.usage) for r in harvest_texts(texts).collect()}
    assert got == {name: want for name, (_, want) in SHAPES.items() if want}


@pytest.mark.parametrize("tasks,stretch", [(1, 1 << 20), (5, 1 << 20), (3, 2)])
def test_lines_of_one_text(spark, monkeypatch, tasks, stretch):
    """Turns spread over many rows and tasks, also when their summaries are merged in parts."""
    monkeypatch.setattr(tally, "STRETCH", stretch)
    turns = [100, 40, 70, 90, 20, 30, 60, 10]
    items = [("sum", "cli", "", "stdout", i, lines(turn(n, 1))) for i, n in enumerate(turns)]
    items += [("last", "cli", "", "stdout", i, lines(turn(n, 1))) for i, n in enumerate(sorted(turns))]
    items += [("both", "cli", "", "stderr", 0, lines(turn(7, 1))), ("both", "cli", "", "stdout", 1, lines(turn(9, 1)))]
    got = {r.run_id: five(r.usage)[:2] for r in harvest_texts(text_rows(spark, items).repartition(tasks, "seq")).collect()}
    assert got == {"sum": (420, 8), "last": (100, 1), "both": (16, 2)}


def test_sse_turns_once_or_twice(spark):
    text = "\n".join("data: " + json.dumps(turn(n, 1)) for n in (100, 40))
    texts = text_rows(spark, [("a", "cli", "", "stdout", 0, text)])
    assert five(harvest_texts(texts).first().usage)[0] == 140
    assert five(harvest_texts(texts, sse="twice").first().usage)[0] == 280
    data = lambda n: "data: " + json.dumps(turn(n, 1))
    two = text_rows(spark, [("a", "cli", "", "stdout", 0, data(5)), ("a", "cli", "", "stderr", 0, data(10))])
    # stdout twice, then stderr twice: 5, 5, 10, 10 never falls
    assert five(harvest_texts(two, sse="twice").first().usage)[0] == 10


def test_turn_modes(spark):
    texts = text_rows(spark, [("a", "cli", "", "stdout", 0, lines(turn(5, 1), turn(8, 1)))])
    assert five(harvest_texts(texts, turns="sum").first().usage)[0] == 13
    assert five(harvest_texts(texts, turns="last").first().usage)[0] == 8


def test_sources_are_never_added(spark):
    stream = lines({"type": "result", "usage": {"input_tokens": 100, "output_tokens": 10}})
    texts = text_rows(spark, [
        ("same", "cli", "", "stdout", 0, stream), ("same", "session", ".x/rollout.jsonl", "file", 0, stream),
        ("quiet", "cli", "", "stdout", 0, "done"),
        ("quiet", "session", "session.json", "file", 0, lines({"usage": {"input_tokens": 88, "output_tokens": 9}})),
        ("thin", "cli", "", "stdout", 0, lines({"input_tokens": 500, "output_tokens": 20})),
        ("home", "home", ".n/s.jsonl", "file", 0, stream),
        ("stream", "home", ".n/s.jsonl", "file", 0, stream), ("stream", "cli", "", "stderr", 0, lines({"input": 1})),
        ("both", "cli", "stdout", "stdout", 0, lines(turn(100, 1), turn(50, 1))), ("both", "cli", "stderr.log", "stderr", 0, lines(turn(80, 1))),
    ])
    side = spark.createDataFrame(
        [("thin", "t", 1, '{"input": 1, "output": 1}'), ("side", "t", 1, '{"input": 70, "output": 3, "cacheWrite": 5}'),
         ("list", "t", 1, '[{"input": 70}]'), ("broken", "t", 1, '{"input": 70} x')],
        "run_id string, task_id string, attempt int, text string",
    )
    got = {r.run_id: (r.source, r.usage["input"]) for r in harvest(texts, side).collect()}
    assert got == {"same": ("cli", 100), "quiet": ("session", 88), "thin": ("cli", 500), "side": ("sidecar", 70),
                   "home": ("session", 100), "stream": ("cli", 1), "both": ("cli", 230)}


def test_attempts_add_up(spark):
    rows = [("r", "t", 1, "sidecar", (5, 1, 0, 0, 0)), ("r", "t", 2, "cli", (7, 1, 2, 3, 4)), ("r", "u", 1, "none", (0, 0, 0, 0, 0))]
    df = spark.createDataFrame(rows, f"run_id string, task_id string, attempt int, source string, usage struct<{', '.join(b + ': long' for b in BUCKETS)}>")
    got = [(r.task_id, r.source, five(r.usage)) for r in sum_attempts(df).collect()]
    assert got == [("t", "sidecar", (12, 2, 2, 3, 4))]


def test_best_usage_takes_one_object(spark):
    text = lines({"a": {"usage": {"input": 5}}, "b": {"input": 3, "output": 9}}, {"input": 12})
    nodes = read_nodes(text_rows(spark, [("a", "cli", "", "stdout", 0, text)]), ["run_id", "seq"])
    assert five(best_usage(nodes, ["run_id"], ["seq", "node"]).first().usage)[:2] == (3, 9)


def test_blobs(spark):
    texts = text_rows(spark, [("a", "cli", "", "stdout", 0, 'x {"a":1} [2] y {bad {"c":3}\ndata: {"d":4}'),
                              ("b", "cli", "", "stdout", 0, '[{"a":1},2]')])
    got = [(r.run_id, r.blob, r.sse, r.json) for r in extract_blobs(texts, ["run_id"]).orderBy("run_id", "blob").collect()]
    assert got == [("a", 0, False, '{"a": 1}'), ("a", 1, False, "[2]"), ("a", 2, True, '{"d": 4}'),
                   ("b", 0, False, '{"a": 1}'), ("b", 1, False, "2")]


def test_classify_key(spark):
    """Spellings built from the words of the rules, in snake and camel case; the worker's rules agree with the SQL."""
    cases = [(w, "", "input") for w in V.INPUT_KEYS] + [(w, "", "output") for w in V.OUTPUT_KEYS]
    for bucket, words in (("input", V.INPUT_WORDS), ("output", V.OUTPUT_WORDS), ("reasoning", V.REASONING_WORDS)):
        for w in words:
            cases += [(f"my_{w}_{c}", "", bucket) for c in V.COUNT_WORDS] + [(f"N{w.title()}{c.upper()}", "x", bucket) for c in V.COUNT_WORDS]
    cases += [(f"cache_{w}", "", "cache_write") for w in V.CACHE_WRITE_WORDS] + [(w, "cacheOf", "cache_write") for w in V.CACHE_WRITE_WORDS]
    cases += [("ephemeral-x", "", "cache_write"), ("left", "Cache", "cache_hit"), ("in.cache", "", "cache_hit"), ("", "", None), ("--", "", None)]
    cases += [(w, "usage", None) for w in V.NOT_COUNTS] + [("input_id", "", None), ("outputMs", "", None), ("grand_total", "cache", None),
                                                           ("total_input", "", None), ("prompts", "", None), ("candidate", "", None)]
    df = spark.createDataFrame(cases, "k string, p string, want string").withColumn("got", classify_key("k", "p"))
    assert df.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    assert [(k, p) for k, p, want in cases if bucket_of(k, p) != want] == []


def test_plan_of_the_harvest(spark, tmp_path):
    """Records are summed up before anything is shuffled: no window, no sort of records, nothing written in between."""
    texts = text_rows(spark, [("a", "cli", "", "stdout", i, lines(turn(i, 1))) for i in range(200)])
    before = set(os.listdir(shared_folder(spark)))
    out = harvest_texts(texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1 and set(os.listdir(shared_folder(spark))) == before
    found = tallies(texts.coalesce(1), ["run_id"]).collect()
    assert len(found) == 1 and found[0].turns == 200 and found[0].sums["input"] == sum(range(200))


def test_tally_merges_as_it_adds():
    """Any cut of a text into stretches, in any order of arrival, gives what adding its records one by one does."""
    rng = random.Random(7)
    for _ in range(500):
        records = [(rng.choice(["turn", "turn", "session", "unknown", "group"]),
                    dict(zip(BUCKETS, (rng.choice([1, 5, 5, 9, 2**63 - 1]), rng.randrange(3), 0, rng.randrange(2), rng.randrange(2)))), rng.random() < 0.2)
                   for _ in range(rng.randrange(1, 9))]
        whole = tally.Tally()
        for record in records:
            whole.add(*record)
        cuts = sorted({0, len(records), *(rng.randrange(len(records) + 1) for _ in range(3))})
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            part = tally.Tally()
            for record in records[a:b]:
                part.add(*record)
            parts.append((a, b, part))
        merged = tally.Tally()
        for _, _, part in parts:
            merged.merge(part)
        assert merged.values() == whole.values()
        held = tally.Stretches()
        rng.shuffle(parts)
        for part in parts + parts[:1]:  # one comes again
            held.take([part])
            held = tally.Stretches(held.dump())
        assert [(s, n, t.values()) for s, n, t in held.parts] == [(0, len(records), whole.values())]
        assert tally.settled(t for _, _, t in sorted(parts, key=lambda p: p[:2])) == tally.settled([whole])
