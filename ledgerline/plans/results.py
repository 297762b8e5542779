"""Scoring and rollups over ``documents`` and ``labels``; reports over ``lineitem``; logs over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.jsontext import extract_json_object, object_entries
from ledgerline.operators.reports import (
    blocked_runs, event_snippet, first_error, merge_report, parse_reports, parse_test_log,
)
from ledgerline.operators.scoring import (
    failure_hints, pass_rate_by_test, rank_eligibility, run_totals, score_outputs, seal_tasks, test_pass_rate,
    unknown_tasks, values_match,
)
from ledgerline.plans.registry import events, query, spread, table
from ledgerline.plans.texts import ESCAPED
from ledgerline.session import short_batches
from ledgerline.sources.sinks import packages

# --- scoring ----------------------------------------------------------------------------------


def outputs(spark, sf_dir):
    """A document is the output for its task, a source is a run. The answer, which guesses quality from
    length, stands in the text in a way that depends on the language."""
    short_batches(spark)
    guess = F.when(F.col("n_chars") > 400, 1).otherwise(0)
    plain = F.format_string('{"quality": %d, "toxic": 0, "note": "n"}', guess)
    output = (
        F.when(F.col("lang") == "en", F.concat("text", F.lit("\n```json\n"), plain, F.lit("\n```\n"), "text"))
        .when(F.col("lang") == "fr", F.concat("text", plain, "text"))
        .when(F.col("lang") == "de", F.format_string(' {"toxic": false, "quality": %d.0000001}\n', guess))
        .otherwise(F.concat("text", F.format_string('{"quality": "%d", "toxic": 0}', guess)))
    )
    usage = F.struct(
        F.col("n_chars").alias("input"), guess.alias("output"), F.lit(None).cast("long").alias("reasoning"),
        F.lit(2).alias("cache_hit"), F.lit(None).cast("long").alias("cache_write"),
    )
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("task_id"), output.alias("output"), usage.alias("usage"),
        F.when(F.col("lang") == "en", 3).alias("attempts"), F.lit("cli").alias("provider_source"), "lang", "n_chars",
    )


def specs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("task_id"), F.to_json(F.struct("quality", "toxic")).alias("expected"),
        F.sha2(F.col("doc_id").cast("string"), 256).alias("prompt_hash"),
    )


_SCORED = """
s AS (SELECT d.source AS run_id, d.doc_id AS task_id, d.lang, d.n_chars, d.text,
  lang <> 'es' AND l.quality = (n_chars > 400)::INT AND l.toxic = 0 AS passed,
  (n_chars > 400)::INT AS guess FROM documents d JOIN labels l USING (doc_id))"""


@query("score_outputs", f"WITH {_SCORED} SELECT run_id, task_id, passed FROM s")
def scored(spark, sf_dir):
    return score_outputs(outputs(spark, sf_dir), specs(spark, sf_dir)).select("run_id", "task_id", "passed")


@query("unknown_tasks", "SELECT source AS run_id, doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown(spark, sf_dir):
    return unknown_tasks(outputs(spark, sf_dir), specs(spark, sf_dir)).select("run_id", "task_id")


_OUTPUT = """CASE lang
  WHEN 'en' THEN text || chr(10) || '```json' || chr(10) || '{"quality": ' || guess || ', "toxic": 0, "note": "n"}' || chr(10) || '```' || chr(10) || text
  WHEN 'fr' THEN text || '{"quality": ' || guess || ', "toxic": 0, "note": "n"}' || text
  WHEN 'de' THEN ' {"toxic": false, "quality": ' || guess || '.0000001}' || chr(10)
  ELSE text || '{"quality": "' || guess || '", "toxic": 0}' END"""


@query(
    "seal_tasks",
    f"""
WITH {_SCORED}
SELECT run_id, task_id, sha256(task_id::VARCHAR) AS prompt_hash, sha256({_OUTPUT}) AS output_hash, passed,
       'extract-json' AS "check", CASE WHEN lang = 'en' THEN 3 ELSE 1 END::BIGINT AS attempts, n_chars AS input, 0::BIGINT AS reasoning FROM s""",
)
def sealed(spark, sf_dir):
    out = seal_tasks(outputs(spark, sf_dir), specs(spark, sf_dir))
    return out.select("run_id", "task_id", "prompt_hash", "output_hash", "passed", "check", "attempts", "usage.input", "usage.reasoning")


_TOTALS = f"""
WITH {_SCORED}
SELECT {{by}}, count(*) AS tasks, count(*) FILTER (WHERE passed) AS passed, sum(n_chars)::BIGINT AS input, sum(guess)::BIGINT AS output,
       0::BIGINT AS reasoning, 2 * count(*) AS cache_hit, 0::BIGINT AS cache_write {{more}} FROM s GROUP BY {{by}}"""


@query("run_totals", _TOTALS.format(by="run_id", more=""))
def totals(spark, sf_dir):
    return run_totals(seal_tasks(outputs(spark, sf_dir), specs(spark, sf_dir)))


@query("rank_eligibility", _TOTALS.format(by="run_id, lang", more=", bool_and(passed) AS rankable"))
def ranked(spark, sf_dir):
    """Per source and language: runs that short are sometimes complete."""
    raw = outputs(spark, sf_dir).withColumn("run_id", F.concat_ws("/", "run_id", "lang"))
    out = rank_eligibility(run_totals(seal_tasks(raw, specs(spark, sf_dir))))
    parts = F.split("run_id", "/")
    return out.withColumns({"run_id": parts[0], "lang": parts[1]})


@query(
    "extract_json_object",
    """
SELECT doc_id, (n_chars > 400)::INT + CASE WHEN lang = 'de' THEN 0.0000001 ELSE 0 END::DOUBLE AS quality FROM documents""",
)
def extracted(spark, sf_dir):
    rows = outputs(spark, sf_dir).withColumn("found", extract_json_object("output"))
    return rows.select(F.col("task_id").alias("doc_id"), F.get_json_object("found", "$.quality").cast("double").alias("quality"))


@query(
    "totals_bad_rows",
    f"""
WITH {_SCORED} SELECT run_id, count(*) AS tasks, 9223372036854775807::BIGINT AS input, (2 * count(*))::BIGINT AS cache_hit,
  bool_and(passed) AS rankable FROM s GROUP BY run_id HAVING count(*) > 1""",
)
def saturated(spark, sf_dir):
    """Sums over counts as large as they get stop at the largest integer, and ranking goes on."""
    raw = outputs(spark, sf_dir).withColumn("usage", F.col("usage").withField("input", F.lit(2**63 - 1)))
    out = rank_eligibility(run_totals(seal_tasks(raw, specs(spark, sf_dir)))).filter("tasks > 1")
    return out.select("run_id", "tasks", "input", "cache_hit", "rankable")


@query(
    "values_match",
    """
SELECT event_id, upper(event_type) = 'CLICK' AS same_text, abs(value - round(value, 0)) <= 1e-6 AS near, value = 1 AS as_true,
       event_type = 'view' AS same_list, true AS both_null FROM events""",
)
def matched(spark, sf_dir):
    template = '{"t":"  %s ","n":%s,"b":%s,"l":[1,"%s",true],"z":null}'
    rows = spread(table(spark, sf_dir, "events")).withColumns({
        "_x": object_entries(F.format_string(template, F.upper("event_type"), F.col("value").cast("string"), F.col("value").cast("string"), "event_type")),
        "_y": object_entries(F.format_string(
            '{"t":"click","n":%s,"b":true,"l":[1.0,"view",1],"z":null}', F.round("value", 0).cast("string"))),
    })
    names = {"t": "same_text", "n": "near", "b": "as_true", "l": "same_list", "z": "both_null"}
    return rows.select("event_id", *[values_match(F.col("_y")[k], F.col("_x")[k]).alias(n) for k, n in names.items()])


# --- packages ---------------------------------------------------------------------------------

_SUITE = dict(format="package/1", evaluator="check", evaluatorVersion="1", suiteVersion="v1", suiteHash="0")
_TEXT = ESCAPED.replace("string_split(text, '')", "string_split(output, '')")


def packed(spark, sf_dir):
    """A package per source."""
    sealed = seal_tasks(outputs(spark, sf_dir), specs(spark, sf_dir))
    stack = F.struct(F.lit("Big Model").alias("modelSlug"), F.lit("pi").alias("harnessSlug"), F.col("run_id").alias("setting"))
    runs = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id")).distinct().select(
        "run_id", F.lit("s").alias("started_at"), F.lit("f").alias("finished_at"), stack.alias("stack")
    )
    return packages(sealed, runs, _SUITE)


@query(
    "packages",
    f"""
WITH {_SCORED}, o AS (SELECT *, {_OUTPUT} AS output FROM s),
t AS (SELECT run_id, task_id, passed, n_chars, guess, '{{"attempts":' || CASE WHEN lang = 'en' THEN 3 ELSE 1 END || ',"check":"extract-json","id":"' || task_id
  || '","output":"' || {_TEXT} || '","outputHash":"' || sha256(output) || '","passed":' || passed || ',"promptHash":"' || sha256(task_id::VARCHAR)
  || '","providerUsage":{{"source":"cli"}},"usage":{{"cacheHit":2,"cacheWrite":0,"input":' || n_chars || ',"output":' || guess || ',"reasoning":0}}}}' AS task FROM o)
SELECT run_id, 'big-model-pi-' || run_id AS name, count(*) AS tasks, sha256(
  '{{"evaluator":{{"name":"check","version":"1"}},"format":"package/1","run":{{"finishedAt":"f","startedAt":"s","tasks":[' || string_agg(task, ',' ORDER BY task_id)
  || ']}},"stack":{{"harnessSlug":"pi","modelSlug":"Big Model","setting":"' || run_id || '"}},"suiteHash":"0","suiteVersion":"v1","totals":{{"cacheHit":' || 2 * count(*)
  || ',"cacheWrite":0,"input":' || sum(n_chars) || ',"output":' || sum(guess) || ',"passed":' || count(*) FILTER (WHERE passed) || ',"reasoning":0,"tasks":' || count(*) || '}}}}') AS integrity
FROM t GROUP BY run_id""",
)
def sealed_packages(spark, sf_dir):
    """The hash a package carries covers every byte before it."""
    tail = F.when(F.col("part") == 2, F.get_json_object(F.concat(F.lit("{"), F.regexp_extract("piece", '"integrity".*$', 0)), "$.integrity"))
    out = packed(spark, sf_dir).withColumn("integrity", tail)
    return out.groupBy("run_id", "name").agg(F.count_if(F.col("part") == 1).alias("tasks"), F.max("integrity").alias("integrity"))


# --- reports ----------------------------------------------------------------------------------

# A document is a run and each of its lines a test: short ones pass, long ones are skipped, others fail.
_LINES = """
lines AS (SELECT doc_id AS run_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'rn': i, 'n': length(x)}), recursive := true) FROM documents),
tests AS (SELECT run_id, rn, n, 'test_' || n AS test, CASE WHEN n < 20 THEN 'ok' WHEN n < 60 THEN 'FAIL' ELSE 'skipped' END AS state FROM lines)"""


def _tests(spark, sf_dir):
    def test(line):
        n = F.char_length(line)
        state = F.when(n < 20, "ok").when(n < 60, "FAIL").otherwise("skipped")
        return F.struct(F.concat(F.lit("test_"), n.cast("string")).alias("test"), state.alias("state"))

    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("run_id"), "lang", "n_chars", F.transform(F.split("text", "\n"), test).alias("tests"))


def _log(spark, sf_dir):
    ran = F.transform("tests", lambda t: F.concat(t["test"], F.lit(" (suite.Case) ... "), t["state"]))
    failed = F.filter("tests", lambda t: t["state"] == "FAIL")
    raised = F.transform(failed, lambda t: F.concat(F.lit("noise\nAssertionError: "), t["test"], F.lit(" broke")))
    log = F.array_join(F.concat(ran, F.array(F.lit("")), raised), "\n")
    return _tests(spark, sf_dir).select("run_id", log.alias("log"))


_PARSED = f"""
WITH {_LINES},
details AS (SELECT run_id, list('AssertionError: ' || test || ' broke' ORDER BY rn) AS d FROM (
  SELECT run_id, test, min(rn) AS rn FROM tests WHERE state = 'FAIL' GROUP BY run_id, test) GROUP BY run_id),
parsed AS (
  SELECT run_id, coalesce(list(test ORDER BY rn) FILTER (WHERE state = 'ok'), []) AS passed_tests,
         coalesce(list(test ORDER BY rn) FILTER (WHERE state = 'FAIL'), []) AS failed_tests,
         coalesce(any_value(d), []) AS details
  FROM tests LEFT JOIN details USING (run_id) GROUP BY run_id)"""


def _joined(name):
    return F.array_join(name, ",").alias({"passedTests": "passed_tests", "failedTests": "failed_tests"}.get(name, name))


@query(
    "parse_test_log",
    _PARSED + "SELECT run_id, array_to_string(passed_tests, ',') AS passed_tests, array_to_string(failed_tests, ',') AS failed_tests, array_to_string(details, ',') AS details FROM parsed",
)
def test_logs(spark, sf_dir):
    return parse_test_log(_log(spark, sf_dir)).select("run_id", _joined("passedTests"), _joined("failedTests"), _joined("details"))


def _reports(spark, sf_dir):
    """Reports as text: missing for German runs, no object for Spanish ones, with lists for long runs, else without."""
    text = (
        F.when(F.col("lang") == "de", F.lit(None))
        .when(F.col("lang") == "es", F.lit("[1, 2]"))
        .when(F.col("n_chars") > 2000, F.lit('{"ok":true,"reward":1,"failed":0,"passedTests":["only"],"failedTests":[]}'))
        .otherwise(F.lit('{"ok":false,"reward":0,"failed":3,"error":"tests failed"}'))
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), text.alias("text"))
    return parse_reports(docs)


_REPORTS = """
reports AS (
  SELECT doc_id AS run_id, good AND long AS ok, (good AND long)::INT AS reward,
         CASE WHEN NOT good THEN 1 WHEN long THEN 0 ELSE 3 END AS failed, good AND long AS listed,
         CASE WHEN lang = 'de' THEN 'no reward.json' WHEN good AND NOT long THEN 'tests failed' END AS error
  FROM (SELECT *, lang NOT IN ('de', 'es') AS good, n_chars > 2000 AS long FROM documents))"""


@query("parse_reports", f"WITH {_REPORTS} SELECT run_id, ok, reward, failed, error FROM reports")
def reports(spark, sf_dir):
    return _reports(spark, sf_dir).select("run_id", "ok", "reward", "failed", "error")


@query(
    "merge_report",
    _PARSED + f""", {_REPORTS}
SELECT r.run_id, CASE WHEN listed THEN 'only' ELSE array_to_string(nullif(passed_tests, []), ',') END AS passed_tests,
       CASE WHEN listed THEN '' ELSE array_to_string(nullif(failed_tests, []), ',') END AS failed_tests,
       CASE WHEN listed THEN NULL ELSE array_to_string(nullif(failed_tests, []), ',') END AS errors
FROM reports r LEFT JOIN parsed p USING (run_id)""",
)
def merged(spark, sf_dir):
    out = merge_report(_reports(spark, sf_dir), parse_test_log(_log(spark, sf_dir)), ["run_id"])
    return out.select("run_id", _joined("passedTests"), _joined("failedTests"), _joined("errors"))


def _run_reports(spark, sf_dir):
    def names(state):
        return F.transform(F.filter("tests", lambda t: t["state"] == state), lambda t: t["test"])

    return _tests(spark, sf_dir).select(
        "run_id", names("ok").alias("passedTests"), names("FAIL").alias("failedTests"),
        F.lit(None).cast("array<string>").alias("errors"), (F.col("lang") == "en").alias("ok"),
    )


@query(
    "test_pass_rate",
    f"""
WITH {_LINES}, c AS (SELECT run_id, count(*) FILTER (WHERE state = 'ok') AS p, count(*) FILTER (WHERE state <> 'skipped') AS n FROM tests GROUP BY run_id)
SELECT run_id, p AS tests_passed, n AS tests_total, CASE WHEN n > 0 THEN p / n WHEN lang = 'en' THEN 1 ELSE 0 END::DOUBLE AS pass_rate
FROM c JOIN documents ON doc_id = run_id""",
)
def rates(spark, sf_dir):
    return test_pass_rate(_run_reports(spark, sf_dir)).select("run_id", "tests_passed", "tests_total", "pass_rate")


@query(
    "pass_rate_by_test",
    f"""
WITH {_LINES} SELECT test, count(*) FILTER (WHERE state = 'ok') AS passes, count(*) AS runs FROM tests WHERE state <> 'skipped' GROUP BY test""",
)
def rates_by_test(spark, sf_dir):
    return pass_rate_by_test(_run_reports(spark, sf_dir)).withColumn("passes", F.col("passes").cast("long"))


@query(
    "failure_hints",
    f"""
WITH {_LINES}, failed AS (SELECT run_id, test, row_number() OVER (PARTITION BY run_id ORDER BY rn) - 1 AS place FROM tests WHERE state = 'FAIL')
SELECT run_id, place::INT AS place, test, coalesce(s_name, 'Re-read that required behavior in the prompt.') AS hint
FROM failed LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON test = 'test_' || s_suppkey""",
)
def hints(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        F.concat(F.lit("test_"), F.col("s_suppkey").cast("string")).alias("test"), F.col("s_name").alias("hint")
    )
    return failure_hints(_run_reports(spark, sf_dir), ["run_id"], known)


# --- agent output -----------------------------------------------------------------------------


def _output_lines(spark, sf_dir):
    """One output line per event, of a kind that goes by its type."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    line = (
        F.when(kind == "signup", F.format_string('{"type":"system","subtype":"start %s"}', k))
        .when(kind == "purchase", F.format_string('{"type":"tool_use","name":"buy","input":{"file_path":"shop/%s/item.py"}}', k))
        .when(kind == "view", F.format_string('{"type":"assistant","message":{"content":[{"type":"x"},{"type":"message","text":"saw  %s"}]}}', k))
        .when(kind == "click", F.format_string("  clicked   %s\n", "props"))
        .otherwise(F.format_string('[1, {"type":"error","message":{"error":"code %s"},"stop_reason":"quit"}]', k))
    )
    return spread(events(spark, sf_dir)).select(
        "event_id", "user_id", "event_type", F.col("event_id").alias("seq"), line.alias("text"),
        F.when(kind == "error", "stderr").otherwise("stdout").alias("stream"),
    )


_K = "(props::JSON->>'k')"


@query(
    "event_snippet",
    f"""
SELECT event_id, CASE event_type WHEN 'signup' THEN 'cli start ' || {_K} WHEN 'purchase' THEN 'buy item.py'
  WHEN 'view' THEN 'model saw ' || {_K} WHEN 'click' THEN 'clicked ' || props ELSE 'cli error code ' || {_K} END AS label FROM events""",
)
def labels(spark, sf_dir):
    return _output_lines(spark, sf_dir).select("event_id", event_snippet("text").alias("label"))


@query(
    "first_error",
    f"""
SELECT user_id, coalesce(arg_min('code ' || {_K} || ' (quit)', event_id) FILTER (WHERE event_type = 'error'),
  arg_max(CASE event_type WHEN 'signup' THEN '{{"type":"system","subtype":"start ' || {_K} || '"}}'
    WHEN 'purchase' THEN '{{"type":"tool_use","name":"buy","input":{{"file_path":"shop/' || {_K} || '/item.py"}}}}'
    WHEN 'view' THEN '{{"type":"assistant","message":{{"content":[{{"type":"x"}},{{"type":"message","text":"saw ' || {_K} || '"}}]}}}}'
    ELSE 'clicked ' || props END, event_id)) AS error
FROM events GROUP BY user_id""",
)
def errors(spark, sf_dir):
    return first_error(_output_lines(spark, sf_dir), ["user_id"])


@query(
    "blocked_runs",
    """
SELECT o_orderkey AS run_id FROM orders
WHERE (o_orderstatus = 'F' AND o_totalprice < 200000) OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')""",
)
def blocked(spark, sf_dir):
    """Finished orders report errors, with tokens where the price is high; partial ones fail in a jail."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "run_id")
    tokens = F.when(F.col("o_totalprice") < 200_000, 0).otherwise(F.floor("o_totalprice"))
    text = (
        F.when(F.col("o_orderstatus") == "F", F.format_string('{"is_error":true,"usage":{"input_tokens":%d},"duration_api_ms":0}', tokens))
        .when(F.col("o_orderstatus") == "P", F.lit("sandbox-exec: not permitted"))
        .otherwise(F.lit('{"is_error":false}'))
    )
    texts = orders.select("run_id", F.lit("stdout").alias("stream"), F.lit(0).alias("seq"), text.alias("text"))
    exits = orders.select("run_id", F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("exit_code"))
    return blocked_runs(texts, exits, ["run_id"])
