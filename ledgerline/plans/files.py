"""Sources and sinks over files that Spark writes from the test tables."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from ledgerline.operators.reports import first_error, parse_reports
from ledgerline.operators.scoring import seal_tasks
from ledgerline.operators.usage import harvest, sum_attempts
from ledgerline.plans import results
from ledgerline.plans.registry import query, table
from ledgerline.session import scratch_path, staged
from ledgerline.sources.files import (
    ATTEMPT_KEYS, answers, left_out, log_line_stream, log_lines, log_texts, report_texts, session_logs, sidecars, task_definitions, task_files,
)
from ledgerline.sources.sinks import write_files, write_packages, write_usage
from ledgerline.streaming.io import BATCH, read_upserts, run_to_table, upsert_stream
from ledgerline.streaming.usage import harvest_stream


@query(
    "session_logs",
    """
SELECT 'run=' || source AS run_id, count(DISTINCT lang) AS files, 'session' AS source, max(n_chars) AS input
FROM documents GROUP BY documents.source""",
)
def sessions(spark, sf_dir):
    """Every source is a run and leaves one file of JSON lines per language in a hidden folder."""
    root = scratch_path(spark, "runs")
    usage = F.struct(F.col("n_chars").alias("input_tokens")).alias("usage")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("lang").alias(".cli"), usage)
    rows.repartition("run", "`.cli`").write.partitionBy("run", ".cli").json(root)
    logs = session_logs(spark, root)
    files = logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"))
    usage = harvest(logs, by=["run_id"]).select("run_id", "source", "usage.input")
    return files.join(usage, "run_id")


@query(
    "package_files",
    """
SELECT source AS run_id, count(*) + 2 AS pieces, sum(CASE WHEN starts_with(lang, 'e') THEN 1 ELSE 0 END)::BIGINT AS e_tasks
FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def package_files(spark, sf_dir):
    """Packages written out and read back, piece by piece."""
    path = scratch_path(spark, "packages")
    write_packages(results.packed(spark, sf_dir), path)
    back = spark.read.text(path)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    ids = back.select("run_id", F.regexp_extract("value", '^,?\\{"attempts":\\d+,"check":"[^"]*","id":"(\\d+)"', 1).alias("id"))
    marked = ids.join(docs.filter("startswith(lang, 'e')"), "id", "left")
    return marked.groupBy("run_id").agg(F.count(F.lit(1)).alias("pieces"), F.count("lang").alias("e_tasks"))


@query(
    "usage_files",
    """
SELECT source AS run_id, sum(n_chars)::BIGINT AS input, 2 * count(*) AS "cacheHit", 0::BIGINT AS "cacheWrite"
FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def usage_files(spark, sf_dir):
    path = scratch_path(spark, "usage")
    sealed = seal_tasks(results.outputs(spark, sf_dir), results.specs(spark, sf_dir))
    write_usage(sealed, path, ["run_id"])
    back = spark.read.schema("input long, output long, reasoning long, cacheHit long, cacheWrite long, run_id string").json(path)
    return back.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("input", "cacheHit", "cacheWrite")])


@query(
    "log_line_stream",
    """
SELECT run_id, 't' || task AS task_id, 2 AS attempt, stream, count(*) AS lines, sum(length(line))::BIGINT AS chars
FROM (SELECT 'r ' || (doc_id // 64) || '%20#' AS run_id, doc_id % 4 AS task, CASE doc_id % 2 WHEN 0 THEN 'stderr' ELSE 'stdout' END AS stream,
  unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL""",
)
def lines(spark, sf_dir):
    """Documents as captured output of attempts, in folders with odd names, streamed back line by line."""
    root = scratch_path(spark, "streams")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    folder = F.format_string("r %d%%20#/t%d/2", F.floor(F.col("doc_id") / 64), F.col("doc_id") % 4)
    stream = F.when(F.col("doc_id") % 2 == 0, "stderr").otherwise("stdout")
    rows = docs.select(folder.alias("folder"), stream.alias("stream"), "doc_id", "text")
    write_files(_joined(rows, ["folder", "stream"], "doc_id", "text", F.concat("folder", F.lit("/"), "stream", F.lit(".log"))), root)
    found = run_to_table(log_line_stream(spark, root, settle_ms=0), "lines")
    return found.groupBy("run_id", "task_id", "attempt", "stream").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("chars")
    )


def _joined(rows, by, order, text, path):
    """Files of a few lines each: the rows of a key joined by line feeds."""
    kept = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*by).agg(F.array_join(kept, "\n").alias("text")).select(path.alias("path"), "text")


def _homes(spark, sf_dir):
    root = scratch_path(spark, "homes")
    usage = F.struct(F.col("n_chars").alias("input_tokens")).alias("usage")
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("home"), F.lit("x").alias(".cli"), F.col("source").alias("s"), usage)
    rows.repartition("home", "s").write.partitionBy("home", ".cli", "s").json(root)
    return root


@query(
    "home_logs",
    """
SELECT 'home=' || lang AS run_id, count(DISTINCT documents.source) AS files, 'session' AS source, max(n_chars) AS input
FROM documents GROUP BY lang""",
)
def home_files(spark, sf_dir):
    """Every language is a home with a file per source, two levels below a hidden folder; more files than any cap."""
    logs = session_logs(spark, _homes(spark, sf_dir), home=True)
    files = logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"))
    return files.join(harvest(logs, by=["run_id"]).select("run_id", "source", "usage.input"), "run_id")


#: Conversations that share a run, so that runs grow in number with the table, not in size.
_PER_RUN = 20
_RUN_SQL = f"(conv_id // {_PER_RUN}) || ''"


def _captured(spark, sf_dir):
    """Runs of conversations: turns of users on stdout, all others on stderr, as JSON lines in order."""
    root = scratch_path(spark, "captured")
    _capture(spark, sf_dir, root)
    return root


def _capture(spark, sf_dir, root, step=None):
    """Write the runs, or one step of three of them as a file of its own per stream."""
    turn = F.format_string('{"type":"turn.completed","usage":{"input_tokens":%d}}', F.char_length("text"))
    error = F.format_string('{"type":"error","message":"%d/%d"}', "conv_id", "turn")
    user = F.col("role") == "user"
    rows = table(spark, sf_dir, "conversations").withColumns({
        "line": F.concat(turn, F.when(user, "").otherwise(error)), "stream": F.when(user, "stdout").otherwise("stderr"),
        "run": F.floor(F.col("conv_id") / _PER_RUN), "place": F.struct("conv_id", "turn"),
    })
    name = F.concat_ws("/", F.col("run").cast("string"), F.lit("t/2"), "stream")
    if step is not None:
        rows, name = rows.filter(F.col("conv_id") % _PER_RUN % 3 == step), F.concat(name, F.lit(f"/{step}"))
    write_files(_joined(rows, ["run", "stream"], "place", "line", name), root)


_STREAMS_SQL = f"""
WITH t AS (SELECT {_RUN_SQL} AS run_id, length(text) AS n, row_number() OVER (
  PARTITION BY conv_id // {_PER_RUN} ORDER BY role <> 'user', {{step}} conv_id, turn) AS place FROM conversations),
steps AS (SELECT *, coalesce(n >= lag(n) OVER (PARTITION BY run_id ORDER BY place), true) AS up FROM t)
SELECT run_id, 't' AS task_id, 2 AS attempt, 'cli' AS source,
  (CASE WHEN bool_and(up) THEN max(n) ELSE sum(n) END)::BIGINT AS input FROM steps GROUP BY run_id"""


@query("harvest_streams", _STREAMS_SQL.format(step=""))
def both_streams(spark, sf_dir):
    """The turns of an attempt on both its streams are added up as one text."""
    usage = harvest(log_lines(spark, _captured(spark, sf_dir)), whole=False)
    return usage.select("run_id", "task_id", "attempt", "source", "usage.input")


@query("harvest_stream", _STREAMS_SQL.format(step=f"conv_id % {_PER_RUN} % 3,"))
def streamed_usage(spark, sf_dir):
    """The same runs while they are written: three micro-batches, each with a third of every stream's lines as another file."""
    root, out = scratch_path(spark, "growing"), scratch_path(spark, "usage")
    for step in range(3):
        _capture(spark, sf_dir, root, step)
        usage = harvest_stream(log_line_stream(spark, root, settle_ms=0))
        upsert_stream(usage, out, ATTEMPT_KEYS, [BATCH], f"{out}-progress", buckets=8).awaitTermination()
    return read_upserts(spark, out).select(*ATTEMPT_KEYS, "source", "usage.input")


@query(
    "harvest_values",
    """
SELECT (doc_id // 16) || '' AS run_id, 'cli' AS source, max(n_chars) AS input FROM documents GROUP BY doc_id // 16""",
)
def values_over_lines(spark, sf_dir):
    """Every stream is one JSON list over many lines, text with brackets and quotes in it included."""
    root = scratch_path(spark, "values")
    usage = F.struct(F.lit("result").alias("type"), F.struct(F.col("n_chars").alias("input_tokens")).alias("usage"), F.col("text").alias("note"))
    rows = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 16)).cast("string").alias("run"), "doc_id", usage.alias("value"))
    lists = rows.groupBy("run").agg(F.to_json(F.collect_list("value"), {"pretty": "true"}).alias("text"))
    write_files(lists.select(F.concat("run", F.lit("/stdout")).alias("path"), "text"), root)
    return harvest(log_lines(spark, root), whole=False).select("run_id", "source", "usage.input")


@query(
    "stream_errors",
    f"""
SELECT {_RUN_SQL} AS run_id, 't' AS task_id, 2 AS attempt, arg_min(conv_id || '/' || turn, (conv_id, turn)) AS error
FROM conversations WHERE role <> 'user' GROUP BY conv_id // {_PER_RUN}""",
)
def stream_errors(spark, sf_dir):
    """One first error per attempt, from whole streams; a run without any ends in a line that is none."""
    return first_error(log_texts(spark, _captured(spark, sf_dir))).filter("error not like '{%'")


#: Documents of a run, of which each task has two attempts with eight documents each.
_DOCS_PER_RUN = 64


def _attempt_docs(spark, sf_dir):
    """Documents as what attempts leave behind: ``kind`` says where a document's length is written."""
    doc = F.col("doc_id")
    place = F.floor(doc / 8) % 8
    kind = F.when(F.floor(doc / _DOCS_PER_RUN) % 3 == 0, "home").when(place < 3, "stdout").when(place < 5, "session").when(place == 5, "sidecar").otherwise("stderr")
    return table(spark, sf_dir, "documents").select(
        F.floor(doc / _DOCS_PER_RUN).cast("string").alias("run_id"), F.format_string("t%d", doc % 4).alias("task_id"),
        (1 + F.floor(doc / 4) % 2).cast("int").alias("attempt"), kind.alias("kind"), "doc_id", "n_chars",
    )


_DOCS_SQL = f"""docs AS (
  SELECT (doc_id // {_DOCS_PER_RUN}) || '' AS run_id, 't' || (doc_id % 4) AS task_id, (1 + (doc_id // 4) % 2)::INT AS attempt, doc_id, n_chars AS n,
    CASE WHEN doc_id // {_DOCS_PER_RUN} % 3 = 0 THEN 'home' WHEN doc_id // 8 % 8 < 3 THEN 'stdout' WHEN doc_id // 8 % 8 < 5 THEN 'session'
      WHEN doc_id // 8 % 8 = 5 THEN 'sidecar' ELSE 'stderr' END AS kind FROM documents
), steps AS (
  SELECT *, coalesce(n >= lag(n) OVER (PARTITION BY run_id, task_id, attempt ORDER BY kind DESC, doc_id), true) AS up FROM docs WHERE kind LIKE 'std%'
), found AS (
  SELECT run_id, task_id, attempt, 'cli' AS source, (CASE WHEN bool_and(up) THEN max(n) ELSE sum(n) END)::BIGINT AS input FROM steps GROUP BY ALL
  UNION ALL SELECT run_id, task_id, attempt, kind, max(n) FROM docs WHERE kind IN ('session', 'sidecar') GROUP BY ALL
), home AS (
  SELECT run_id, 't' || min(doc_id % 4) AS task_id, attempt, max(n) AS input FROM docs WHERE kind = 'home' GROUP BY run_id, attempt
), best AS (
  SELECT run_id, task_id, attempt, arg_max(source, (input, CASE source WHEN 'cli' THEN 2 WHEN 'sidecar' THEN 1 ELSE 0 END)) AS source, max(input) AS input
  FROM found WHERE input > 0 GROUP BY ALL
  UNION ALL SELECT run_id, task_id, attempt, 'session', input FROM home
)"""


def _attempts_written(spark, sf_dir):
    """``(root, homes, attempts)``: four sources of two attempts a task, the second's files changed after it began."""
    root, homes = scratch_path(spark, "runs"), scratch_path(spark, "homes")
    docs = staged(_attempt_docs(spark, sf_dir), "docs")
    folder = F.concat_ws("/", "run_id", "task_id", F.col("attempt").cast("string"))
    turn = F.format_string('{"type":"turn.completed","usage":{"input_tokens":%d}}', "n_chars")
    total = F.format_string('{"input":%d}', "n_chars")
    streams = docs.filter("kind like 'std%'").select(folder.alias("folder"), "kind", "doc_id", turn.alias("line"))
    write_files(_joined(streams, ["folder", "kind"], "doc_id", "line", F.concat("folder", F.lit("/"), "kind")), root)
    write_files(docs.filter("kind = 'session'").select(F.concat(folder, F.format_string("/.cli/a b/%d.json", "doc_id")).alias("path"), total.alias("text")), root)
    side = docs.filter("kind = 'sidecar'").groupBy("run_id", "task_id", "attempt").agg(F.max("n_chars").alias("n_chars"))
    write_files(side.select(F.concat(folder, F.lit("/usage.json")).alias("path"), total.alias("text")), root)
    at_home = docs.filter("kind = 'home'")
    begun = {}
    for n in (1, 2):  # a file belongs to an attempt too if it was changed less than two seconds before that attempt
        time.sleep(2.2 if n == 2 and at_home.head(1) else 0)
        begun[n] = dt.datetime.now(dt.timezone.utc)
        files = at_home.filter(F.col("attempt") == n).select(F.format_string("%s/.cli/%%41 #/%d.json", "run_id", "doc_id").alias("path"), total.alias("text"))
        write_files(files, homes)
    started = F.when(F.col("attempt") == 1, F.lit(begun[1])).otherwise(F.lit(begun[2]))
    # a home's attempts follow each other: one task of it
    attempts = docs.groupBy("run_id", "attempt").agg(F.min("task_id").alias("task_id")).withColumn("started", started)
    return root, homes, attempts


def _harvested(spark, sf_dir):
    root, homes, attempts = _attempts_written(spark, sf_dir)
    texts = log_texts(spark, root).unionByName(session_logs(spark, root)).unionByName(session_logs(spark, homes, home=True, attempts=attempts))
    return harvest(texts, sidecars(spark, root))


@query("attempt_sources", f"WITH {_DOCS_SQL} SELECT * FROM best")
def attempt_sources(spark, sf_dir):
    """Streams, sidecars, session files and home files of two attempts a task, each attempt on its own."""
    return _harvested(spark, sf_dir).select(*ATTEMPT_KEYS, "source", "usage.input")


@query("attempt_totals", f"WITH {_DOCS_SQL} SELECT run_id, task_id, sum(input)::BIGINT AS input, arg_min(source, attempt) AS source FROM best GROUP BY run_id, task_id")
def attempt_totals(spark, sf_dir):
    """The attempts of a task added up."""
    return sum_attempts(_harvested(spark, sf_dir)).select("run_id", "task_id", "usage.input", "source")


@query(
    "left_out",
    """
SELECT 'home=' || lang AS run_id, NULL::VARCHAR AS task_id, 1 AS attempt, count(DISTINCT source) - 5 AS files FROM documents
GROUP BY lang HAVING count(DISTINCT source) > 5""",
)
def limited(spark, sf_dir):
    """What a limit of five files leaves out of homes with a file per source."""
    out = left_out(spark, _homes(spark, sf_dir), home=True, max_files=5)
    return out.groupBy(*ATTEMPT_KEYS).agg(F.count(F.lit(1)).alias("files"))


@query(
    "answers",
    """
SELECT source AS run_id, CASE count(*) % 3 WHEN 0 THEN '' WHEN 1 THEN 'first ' || count(*) ELSE 'second ' || count(*) END AS output
FROM documents GROUP BY source""",
)
def answered(spark, sf_dir):
    """A source's ``answer.json`` stands before its ``out.json``; some have the second only, some none."""
    root = scratch_path(spark, "answers")
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg(F.count("*").alias("k"))
    first = counts.filter("k % 3 = 1").select(F.concat("run_id", F.lit("/answer.json")).alias("path"), F.format_string("first %d", "k").alias("text"))
    second = counts.filter("k % 3 > 0").select(F.concat("run_id", F.lit("/out.json")).alias("path"), F.format_string("second %d", "k").alias("text"))
    write_files(first.unionByName(second), root)
    return answers(spark, root, counts.select("run_id"))


@query(
    "sidecar_files",
    """
SELECT source AS run_id, sum(n_chars)::BIGINT AS input, count(*) AS output FROM documents GROUP BY source""",
)
def sidecar_files(spark, sf_dir):
    """A sidecar per source with the sizes of all its documents."""
    root = scratch_path(spark, "sidecars")
    sums = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"), F.count("*").alias("k"))
    write_files(sums.select(F.concat("source", F.lit("/usage.json")).alias("path"), F.format_string('{"input": %d, "output": %d}', "n", "k").alias("text")), root)
    return harvest(log_texts(spark, root), sidecars(spark, root)).select("run_id", "usage.input", "usage.output")


@query(
    "report_files",
    """
SELECT source AS run_id, CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END AS reward,
  CASE WHEN count(*) % 2 = 0 THEN sum(n_chars % 100) ELSE 1 END::INT AS failed,
  CASE WHEN count(*) % 2 = 1 THEN 'no reward.json' END AS error
FROM documents GROUP BY source""",
)
def report_files(spark, sf_dir):
    """Sources with an even number of documents leave a report; the others have none."""
    root = scratch_path(spark, "reports")
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg(
        F.sum(F.col("n_chars") % 100).alias("n"), F.count("*").alias("k")
    )
    report = F.format_string('{"ok":true,"reward":1,"failed":%d}', "n")
    write_files(counts.filter("k % 2 = 0").select(F.concat("run_id", F.lit("/reward.json")).alias("path"), report.alias("text")), root)
    return parse_reports(report_texts(spark, root, counts)).select("run_id", "reward", "failed", "error")


@query(
    "task_folders",
    """
SELECT CASE WHEN count(*) % 2 = 0 THEN 'id-' || source ELSE source END AS task_id, 'Label ' || source AS label,
  min(text) AS instruction, '{"n":' || count(*) || '}' AS expected, length(max(text))::BIGINT AS repo_chars
FROM documents GROUP BY source""",
)
def task_folders(spark, sf_dir):
    """A task folder per source: its first text is the instruction, its last the repository."""
    root = scratch_path(spark, "tasks")
    found = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min("text").alias("first"), F.max("text").alias("last"), F.count("*").alias("k")
    )
    folder = F.concat(F.lit("01-"), "source", F.lit("/"))
    parts = {"instruction.md": F.col("first"), "expected.json": F.format_string('{"n":%d}', "k"), "label.txt": F.format_string(" Label %s\n", "source"),
             "environment/repo/a/b.py": F.col("last"), "id.txt": F.when(F.col("k") % 2 == 0, F.format_string("id-%s\n", "source"))}
    files = F.array(*[F.struct(F.concat(folder, F.lit(name)).alias("path"), text.alias("text")) for name, text in parts.items()])
    write_files(found.select("source", F.inline(files)).filter("text is not null"), root)
    sizes = task_files(spark, root).groupBy("task_folder").agg(F.sum(F.char_length("text")).alias("repo_chars"))
    out = task_definitions(spark, root).join(sizes, "task_folder")
    return out.select("task_id", "label", "instruction", "expected", "repo_chars")
