"""Token usage from log text made of ``conversations``, ``documents`` and ``events``.

Each conversation is a run whose turns are lines of its log. Counts come from the lengths of the
texts, so the SQL can work them out without any JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.keys import BUCKETS
from ledgerline.operators.decode import extract_blobs
from ledgerline.operators.usage import (
    best_usage, billed, extract_fields, harvest, harvest_texts, kind_of, own_usage, pick_richer, read_nodes, score, sum_attempts,
    unwrapped_usage,
)
from ledgerline.plans.registry import query, spread, table

RUN = ["run_id"]


def _turns(spark, sf_dir):
    """Conversations as log rows: length and words of each turn beside its place."""
    return spread(table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.lit("stdout").alias("stream"), "role",
        F.char_length("text").alias("chars"), F.size(F.split("text", " ")).alias("words"), "text",
    )


def _line(df, *pairs):
    """``text`` as a JSON line. ``pairs``: JSON with ``%`` places, and the columns for them."""
    template, *columns = pairs
    return df.withColumn("text", F.format_string(template, *columns))


def _five(df, *keep):
    return df.select(*keep, *[F.col(f"usage.{b}").alias(b) for b in BUCKETS])


_T = """t AS (SELECT conv_id AS run_id, turn AS seq, role, length(text) AS chars, len(string_split(text, ' ')) AS words, text
  FROM conversations)"""
_RISING = """steps AS (SELECT *, coalesce({n} >= lag({n}) OVER (PARTITION BY {by} ORDER BY seq), true) AS up FROM t {where})"""


# The usage object inside a turn is read as a session of its own, so an earlier turn can be the richer.
_LAST = "CASE WHEN max({n} + words) > arg_max({n} + words, seq) THEN arg_max({v}, ({n} + words, -seq)) ELSE arg_max({v}, seq) END"


def _turn_sum(n, by="run_id", where=""):
    """Last turn if ``n`` never falls (or a richer one), else the sum, per run."""
    steps = _RISING.format(n=n, by=by, where=where)
    take = lambda v: f"(CASE WHEN bool_and(up) THEN {_LAST.format(n=n, v=v)} ELSE sum({v}) END)::BIGINT"
    return f"""
WITH {_T}, {steps}
SELECT {by}, {take(n)} AS input, {take("words")} AS output,
       0::BIGINT AS reasoning, 0::BIGINT AS cache_hit, 0::BIGINT AS cache_write FROM steps GROUP BY {by}"""


_TURN = '{"type":"turn.completed","usage":{"input_tokens":%d,"output_tokens":%d}}'


@query("aggregate_turns", _turn_sum("chars"))
def turns(spark, sf_dir):
    rows = _line(_turns(spark, sf_dir), _TURN, "chars", "words")
    return _five(harvest_texts(rows, RUN), *RUN)


@query(
    "turns_forced",
    f"""
WITH {_T} SELECT run_id, sum(chars)::BIGINT AS summed, {_LAST.format(n="chars", v="chars")} AS last FROM t GROUP BY run_id""",
)
def forced(spark, sf_dir):
    rows = _line(_turns(spark, sf_dir), _TURN, "chars", "words")
    summed = harvest_texts(rows, RUN, turns="sum").select(*RUN, F.col("usage.input").alias("summed"))
    last = harvest_texts(rows, RUN, turns="last").select(*RUN, F.col("usage.input").alias("last"))
    return summed.join(last, RUN)


@query(
    "sse_lines",
    f"""
WITH {_T}, twice AS (SELECT run_id, seq, chars, 0 AS pass FROM t UNION ALL SELECT run_id, seq, chars, 1 FROM t),
once_up AS (SELECT run_id, chars, seq, coalesce(chars >= lag(chars) OVER (PARTITION BY run_id ORDER BY seq), true) AS up FROM t),
twice_up AS (SELECT run_id, chars, pass, seq, coalesce(chars >= lag(chars) OVER (PARTITION BY run_id ORDER BY pass, seq), true) AS up FROM twice),
o AS (SELECT run_id, (CASE WHEN bool_and(up) THEN arg_max(chars, seq) ELSE sum(chars) END)::BIGINT AS once FROM once_up GROUP BY run_id),
w AS (SELECT run_id, (CASE WHEN bool_and(up) THEN arg_max(chars, 1000 * pass + seq) ELSE sum(chars) END)::BIGINT AS twice FROM twice_up GROUP BY run_id)
SELECT run_id, once, twice FROM o JOIN w USING (run_id)""",
)
def sse(spark, sf_dir):
    rows = _line(_turns(spark, sf_dir), "event: usage\ndata: " + _TURN, "chars", "words")
    once = harvest_texts(rows, RUN).select(*RUN, F.col("usage.input").alias("once"))
    twice = harvest_texts(rows, RUN, sse="twice").select(*RUN, F.col("usage.input").alias("twice"))
    return once.join(twice, RUN)


@query(
    "richest_session",
    f"""
WITH {_T}, s AS (SELECT run_id, seq, chars, words, chars % 7 AS hit, words % 5 AS wr FROM t)
SELECT run_id, best.i AS input, best.o AS output, 0::BIGINT AS reasoning, best.h AS cache_hit, best.w AS cache_write
FROM (SELECT run_id, arg_max({{'i': chars, 'o': words, 'h': hit, 'w': wr}}, (chars + words + hit + wr, wr, -seq)) AS best
      FROM s GROUP BY run_id)""",
)
def sessions(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumns({"hit": F.col("chars") % 7, "wr": F.col("words") % 5})
    template = (
        '{"type":"result","total_cost":0.5,"usage":{"prompt_tokens":%d,"completion_tokens":%d,'
        '"prompt_tokens_details":{"cached_tokens":%d},"cache":{"write":%d}}}'
    )
    return _five(harvest_texts(_line(rows, template, "chars", "words", "hit", "wr"), RUN), *RUN)


@query(
    "group_sum",
    f"""
WITH {_T}
SELECT run_id, seq, (chars + words)::BIGINT AS input, (words + 1)::BIGINT AS output, 2::BIGINT AS reasoning,
       chars AS cache_hit, 0::BIGINT AS cache_write FROM t""",
)
def groups(spark, sf_dir):
    """Two models per line, added up; the members are no records themselves."""
    template = (
        '{"stats":{"models":{"north":{"tokens":{"prompt":%d,"candidates":%d,"thoughts":2}},'
        '"south":{"tokens":{"prompt":%d,"candidates":1,"cached":%d}}}}}'
    )
    rows = _line(_turns(spark, sf_dir), template, "chars", "words", "words", "chars")
    return _five(harvest_texts(rows, ["run_id", "seq"]), "run_id", "seq")


@query(
    "reconcile",
    f"""
WITH {_T}, {_RISING.format(n="chars", by="run_id", where="WHERE role = 'user'")},
u AS (SELECT run_id, (CASE WHEN bool_and(up) THEN arg_max(chars, seq) ELSE sum(chars) END)::BIGINT AS n FROM steps GROUP BY run_id),
s AS (SELECT run_id, max(chars) AS n FROM t WHERE role <> 'user' GROUP BY run_id)
SELECT run_id, coalesce(u.n, s.n) AS input FROM u FULL JOIN s USING (run_id)""",
)
def reconciled(spark, sf_dir):
    """User rows report turns, all others sessions of the same record type: the turns stand."""
    scope = F.when(F.col("role") == "user", "turn").otherwise("session")
    rows = _line(_turns(spark, sf_dir), '{"type":"usage.record","scope":"%s","usage":{"inputOther":%d}}', scope, "chars")
    return harvest_texts(rows, RUN).select(*RUN, F.col("usage.input").alias("input"))


@query(
    "usage_per_object",
    """
SELECT doc_id, greatest(n_chars, 3) AS input, (n_chars // 3)::BIGINT AS output, (doc_id % 11)::BIGINT AS reasoning,
       greatest(n_chars // 2, 0)::BIGINT AS cache_hit, (5 + n_chars + doc_id % 13)::BIGINT AS cache_write FROM documents""",
)
def per_object(spark, sf_dir):
    """Counts as digits, integral floats, boxes and lists; the largest per bucket; write parts added."""
    template = (
        '{"inputTokens":"%d","prompt":3.0,"output":{"count":%d},"thinking":[%s],"ok":true,"request_id":99999999,'
        '"cacheRead":%d,"cached":1.5,"cache_creation":{"ephemeral_5m":%d,"ephemeral_1h":%d,"ephemeral_x":5},"duration_ms":123456}'
    )
    n, d = F.col("n_chars"), F.col("doc_id")
    ids = F.array_join(F.array_repeat(F.lit("7"), (d % 11).cast("int")), ",")
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.format_string(
        template, n, F.floor(n / 3), ids, F.floor(n / 2), n, d % 13).alias("text"))
    nodes = read_nodes(docs, ["doc_id"]).filter("node = 1")
    return _five(nodes.select("doc_id", own_usage().alias("usage")), "doc_id")


@query(
    "unwrap_usage",
    f"""
WITH {_T} SELECT run_id, seq, (CASE role WHEN 'user' THEN chars WHEN 'assistant' THEN words ELSE 1 END)::BIGINT AS input,
  (CASE role WHEN 'user' THEN chars WHEN 'assistant' THEN words + 2 ELSE 1 END)::BIGINT AS billed FROM t""",
)
def unwrapped(spark, sf_dir):
    """The first usage object that counts anything, in key order, else the object's own counts."""
    text = (
        F.when(F.col("role") == "user", F.format_string('{"input":1,"usage":{"input":%d},"tokens":{"input":9999999}}', "chars"))
        .when(F.col("role") == "assistant", F.format_string('{"usage":{"total":5},"token_counts":{"input":%d,"output":2}}', "words"))
        .otherwise(F.lit('{"input":1,"usage":{"note":"x"}}'))
    )
    rows = _turns(spark, sf_dir).withColumn("text", text)
    nodes = read_nodes(rows, ["run_id", "seq"]).filter("node = 1").withColumn("usage", unwrapped_usage())
    return nodes.select("run_id", "seq", "usage.input", billed(F.col("usage")).alias("billed"))


@query(
    "record_usage",
    f"""
WITH {_T} SELECT run_id, seq, chars::BIGINT AS input, words::BIGINT AS output FROM t""",
)
def records(spark, sf_dir):
    """Usage kept in a part, a message or a payload."""
    text = (
        F.when(F.col("role") == "user", F.format_string('{"type":"step_finish","part":{"tokens":{"input":%d,"output":%d}}}', "chars", "words"))
        .when(F.col("role") == "assistant", F.format_string('{"type":"message_end","message":{"usage":{"input":%d,"output":%d}}}', "chars", "words"))
        .otherwise(F.format_string('{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":%d,"output_tokens":%d}}}}', "chars", "words"))
    )
    rows = _turns(spark, sf_dir).withColumn("text", text)
    return harvest_texts(rows, ["run_id", "seq"]).select("run_id", "seq", "usage.input", "usage.output")


@query(
    "best_usage",
    f"""
WITH {_T} SELECT run_id, max(greatest(chars + words, 2 * words))::BIGINT AS total FROM t GROUP BY run_id""",
)
def best(spark, sf_dir):
    rows = _line(_turns(spark, sf_dir), '{"a":[{"usage":{"input":%d,"output":%d}}],"b":{"output":%d}}', "chars", "words", F.col("words") * 2)
    out = best_usage(read_nodes(rows, ["run_id", "seq"]), RUN, ["seq", "node"])
    return out.select(*RUN, score(F.col("usage")).alias("total"))


@query(
    "pick_richer",
    f"""
WITH {_T} SELECT run_id, seq, CASE WHEN 2 * words >= chars % 40 THEN 'right' ELSE 'left' END AS side FROM t""",
)
def richer(spark, sf_dir):
    def usage(name, **counts):
        return F.struct(*[counts.get(b, F.lit(0)).cast("long").alias(b) for b in BUCKETS], F.lit(name).alias("side"))

    left = usage("left", input=F.col("chars") % 40)
    right = usage("right", output=F.col("words"), cache_write=F.col("words"))
    return _turns(spark, sf_dir).select("run_id", "seq", pick_richer(left, right)["side"].alias("side"))


_SOURCES = f"""
WITH {_T}, n AS (
  SELECT run_id, CASE role WHEN 'user' THEN 'cli' WHEN 'assistant' THEN 'session' ELSE 'sidecar' END AS source, seq, chars FROM t),
per AS (SELECT run_id, source, max(chars) AS input FROM n GROUP BY run_id, source)"""


def _three_sources(spark, sf_dir, attempt):
    rows = _turns(spark, sf_dir).withColumns({"attempt": attempt, "file": F.concat(F.lit("s"), F.col("seq").cast("string"))})
    rows = _line(rows, '{"usage":{"input_tokens":%d}}', "chars")
    source = F.when(F.col("role") == "user", "cli").otherwise("session")
    texts = rows.filter("role <> 'system'").withColumn("source", source)
    return texts, _line(rows.filter("role = 'system'"), '{"input":%d}', "chars")


@query(
    "choose_source",
    _SOURCES + """
SELECT run_id, arg_max(source, (input, CASE source WHEN 'cli' THEN 2 WHEN 'sidecar' THEN 1 ELSE 0 END)) AS source,
       max(input) AS input FROM per GROUP BY run_id""",
)
def sources(spark, sf_dir):
    """User rows are the stream, assistant rows session files, system rows sidecars."""
    texts, sidecars = _three_sources(spark, sf_dir, F.lit(1))
    return harvest(texts, sidecars, RUN).select(*RUN, "source", "usage.input")


@query(
    "sum_attempts",
    f"""
WITH {_T}
SELECT run_id, sum(chars)::BIGINT AS input,
       arg_min(CASE role WHEN 'user' THEN 'cli' WHEN 'assistant' THEN 'session' ELSE 'sidecar' END, seq) AS source
FROM t GROUP BY run_id""",
)
def attempts(spark, sf_dir):
    """Every turn is an attempt with one source; attempts are added."""
    texts, sidecars = _three_sources(spark, sf_dir, F.col("seq"))
    out = sum_attempts(harvest(texts, sidecars, ["run_id", "attempt"]), RUN)
    return out.select(*RUN, "source", "usage.input")


@query(
    "extract_blobs",
    r"""
SELECT doc_id, count(*) AS blobs, count(*) FILTER (WHERE line LIKE 'data:%') AS sse, sum(length(line))::BIGINT AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""",
)
def blobs(spark, sf_dir):
    """Every line of a document ends in an object with its length, and a broken one."""
    text = F.array_join(
        F.transform(F.split("text", "\n"), lambda line: F.concat(line, F.format_string(' {"n": %d} {"n":', F.char_length(line)))), "\n"
    )
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", text.alias("text"))
    rows = extract_blobs(docs, ["doc_id"])
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blobs"),
        F.count_if("sse").alias("sse"),
        F.sum(F.get_json_object("json", "$.n").cast("long")).alias("chars"),
    )


@query(
    "extract_fields",
    """
SELECT bucket, node, count(*) AS n, sum(v)::BIGINT AS total FROM (
  SELECT unnest([{'node': 1, 'bucket': 'input', 'v': k}, {'node': 1, 'bucket': 'cache_hit', 'v': 3}, {'node': 1, 'bucket': NULL, 'v': event_id},
                 {'node': 2, 'bucket': 'input', 'v': k}, {'node': 2, 'bucket': 'cache_hit', 'v': 3}, {'node': 3, 'bucket': NULL, 'v': 3},
                 {'node': 4, 'bucket': 'output', 'v': 1}], recursive := true)
  FROM (SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events)) WHERE v > 0 GROUP BY bucket, node""",
)
def fields(spark, sf_dir):
    """Each object lists its own counts and those of usage-like objects nested in it."""
    template = '{"event_id":%d,"usage":{"input_tokens":%s,"cache":{"read":3}},"items":[[{"output":1}]]}'
    rows = spread(table(spark, sf_dir, "events")).select(
        "event_id", F.format_string(template, "event_id", F.get_json_object("props", "$.k")).alias("text")
    )
    out = extract_fields(read_nodes(rows, ["event_id"], fields=True), ["event_id"])
    return out.groupBy("bucket", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))


@query(
    "walk_objects",
    """
SELECT role, kind, count(*) AS n FROM (
  SELECT role, unnest([CASE role WHEN 'user' THEN 'turn' WHEN 'assistant' THEN 'session' ELSE 'unknown' END, 'unknown']) AS kind
  FROM conversations WHERE length(text) > 0) GROUP BY role, kind""",
)
def walked(spark, sf_dir):
    """The record and the usage object in it are both visited; their kinds differ."""
    kind = F.when(F.col("role") == "user", "turn.completed").when(F.col("role") == "assistant", "result").otherwise("chat")
    rows = _line(_turns(spark, sf_dir), '{"type":"%s","usage":{"input_tokens":%d}}', kind, "chars")
    nodes = read_nodes(rows, ["role"]).select("role", kind_of().alias("kind"))
    return nodes.groupBy("role", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("walk_every_object", "SELECT role, 6 * count(*) AS n FROM conversations GROUP BY role")
def walked_all(spark, sf_dir):
    """Objects with and without counts are visited, in lists too."""
    rows = _line(_turns(spark, sf_dir), '{"usage":{"input_tokens":%d},"meta":{"tags":[{"a":{}},{"b":1.5}]}}', "chars")
    return read_nodes(rows, ["role"], every=True).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "usage_bad_rows",
    f"""
WITH {_T} SELECT run_id, seq, CASE role WHEN 'user' THEN 9223372036854775807 ELSE chars END::BIGINT AS input,
  CASE role WHEN 'user' THEN 9223372036854775807 ELSE chars + words END::BIGINT AS total,
  CASE role WHEN 'assistant' THEN words ELSE 0 END::BIGINT AS cache_write FROM t""",
)
def bad_rows(spark, sf_dir):
    """Counts beyond 64 bits stand as the largest one, sums too; a lone ephemeral part is no write, two are."""
    text = (
        F.when(F.col("role") == "user", F.lit('{"input_tokens":99999999999999999999,"output_tokens":5,"reasoning":1e999}'))
        .when(F.col("role") == "assistant", F.format_string('{"input":%d,"ephemeral_total":%d,"ephemeral_rest_total":0}', "chars", "words"))
        .otherwise(F.format_string('{"input":%d,"ephemeral_total":77,"output":%d}', "chars", "words"))
    )
    rows = _turns(spark, sf_dir).withColumn("text", text)
    out = harvest_texts(rows, ["run_id", "seq"])
    return out.select("run_id", "seq", "usage.input", score(F.col("usage")).alias("total"), "usage.cache_write")
