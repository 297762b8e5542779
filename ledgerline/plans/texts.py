"""Text functions, hashes, work sizes, manifests and canonical JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.jsontext import canonical_json, json_at
from ledgerline.functions.keys import classify_key, record_kind
from ledgerline.functions.text import (
    catalog_id, character_count, content_hash, file_stem, format_elapsed, normalize_text, one_line, path_tail, slug,
    task_tag, work_units,
)
from ledgerline.operators.manifest import manifest, manifest_rejects, package_integrity, suite_size, verify_manifest, work_size
from ledgerline.plans.registry import query, spread, table


@query("content_hash", "SELECT doc_id, sha256(nfc_normalize(text)) AS hash FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("hash"))


@query(
    "normalize_text",
    """SELECT doc_id, sha256(text) AS hash, length(text) AS chars, length(text) / 4.0::DOUBLE AS units FROM documents""",
)
def normalized(spark, sf_dir):
    """The documents with Windows line ends and decomposed accents come back to what they were."""
    text = F.regexp_replace("text", "\n", "\r\n")
    accents = {"é": "é", "è": "è", "ü": "ü", "ñ": "ñ", "ç": "ç"}
    for composed, apart in accents.items():
        text = F.replace(text, F.lit(composed), F.lit(apart))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", text.alias("text"))
    return docs.select(
        "doc_id",
        F.sha2(normalize_text("text"), 256).alias("hash"),
        character_count("text").alias("chars"),
        work_units(character_count("text")).alias("units"),
    )


@query(
    "one_line",
    r"""
SELECT doc_id, CASE WHEN length(line) <= 96 THEN line ELSE substring(line, 1, 93) || '...' END AS line
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents)""",
)
def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", one_line("text", 96).alias("line"))


@query(
    "slugs",
    r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'model') AS slug
FROM pages""",
)
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", slug("url").alias("slug"))


@query(
    "path_tails",
    r"""
SELECT page_id, tail, regexp_replace(tail, '\.[^.]*$', '') AS stem, regexp_replace(tail, '^[^-]*-', '') AS tag
FROM (SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS tail FROM pages)""",
)
def tails(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", path_tail("url").alias("tail"), file_stem("url").alias("stem"), task_tag("url").alias("tag")
    )


@query(
    "format_elapsed",
    """
SELECT o_orderkey, CASE
  WHEN s >= 3600 THEN format('{}h{:02d}m{:02d}s', s // 3600, s // 60 % 60, s % 60)
  WHEN s >= 60 THEN format('{}m{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS elapsed
FROM (SELECT o_orderkey, floor(o_totalprice / 20)::BIGINT AS s FROM orders)""",
)
def elapsed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", format_elapsed(F.col("o_totalprice") / 20).alias("elapsed"))


_HARNESS = {"signup": "claude", "purchase": "gemini", "view": "pi", "click": "api", "error": "unheard-of"}


@query(
    "catalog_ids",
    """
SELECT event_type, CASE event_type WHEN 'signup' THEN 'hrs_claude' WHEN 'purchase' THEN 'hrs_gemini'
  WHEN 'view' THEN 'hrs_pi' WHEN 'click' THEN 'hrs_api' ELSE 'hrs_custom' END AS catalog_id, count(*) AS n
FROM events GROUP BY event_type""",
)
def catalog(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in _HARNESS.items() for x in pair])
    rows = table(spark, sf_dir, "events").select("event_type", catalog_id(names[F.col("event_type")]).alias("catalog_id"))
    return rows.groupBy("event_type", "catalog_id").agg(F.count(F.lit(1)).alias("n"))


_WORDS = [
    "inputTokens", "prompt_token_count", "output", "completionCount", "cacheRead", "cache_creation", "ephemeral_1h",
    "thinking", "reasoningTokens", "total", "totalInput", "generatedTokens", "candidates", "duration_ms", "model",
]
# The event type joins the key on either side, which makes and breaks several of the rules.
_FOLDED = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(
    "classify_keys",
    f"""
WITH keys AS (
  SELECT w, event_type, {_FOLDED.format("event_type || '_' || w")} AS k, {_FOLDED.format("w || upper(event_type)")} AS p
  FROM events, unnest({_WORDS!r}) t(w)),
found AS (
  SELECT w, event_type, CASE
    WHEN k = '' OR k IN ('ok','failed','reward','status','type','id','name','event','kind','scope','level','model','error') THEN NULL
    WHEN suffix(k, 'id') OR suffix(k, 'ms') THEN NULL
    WHEN contains(k, 'total') AND NOT regexp_matches(k, 'input|output|prompt') THEN NULL
    WHEN contains(k, 'ephemeral') THEN 'cache_write'
    WHEN (prefix(p, 'cache') OR contains(k, 'cache')) AND regexp_matches(k, 'write|creation|create|store') THEN 'cache_write'
    WHEN prefix(p, 'cache') OR contains(k, 'cache') THEN 'cache_hit'
    WHEN regexp_matches(k, 'reason|think|thought') THEN 'reasoning'
    WHEN k IN ('input','prompt','promptevalcount') OR prefix(k, 'input') OR (regexp_matches(k, 'input|prompt') AND regexp_matches(k, 'token|count')) THEN 'input'
    WHEN k IN ('output','completion','candidates','evalcount') OR prefix(k, 'output')
      OR (regexp_matches(k, 'output|completion|candidate|generated') AND regexp_matches(k, 'token|count')) THEN 'output'
  END AS bucket FROM keys)
SELECT w AS word, event_type, bucket, count(*) AS n FROM found GROUP BY ALL""",
)
def classified(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "events")).select("event_type", F.explode(F.array(*map(F.lit, _WORDS))).alias("word"))
    rows = rows.withColumn("bucket", classify_key("concat_ws('_', event_type, word)", "concat(word, upper(event_type))"))
    return rows.groupBy("word", "event_type", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "record_kinds",
    """
SELECT role, kind, count(*) AS n FROM (
  SELECT role, CASE WHEN role = 'system' THEN CASE WHEN length(text) > 100 THEN 'turn' ELSE 'session' END
    WHEN role = 'user' THEN 'turn' WHEN length(text) > 100 THEN 'session' ELSE 'unknown' END AS kind
  FROM conversations) GROUP BY role, kind""",
)
def kinds(spark, sf_dir):
    """The scope of system rows decides; other rows go by their type."""
    long, role = F.char_length("text") > 100, F.col("role")
    scope = F.when(role == "system", F.when(long, "Step").otherwise("TOTAL"))
    raw = F.when(role == "assistant", F.when(long, "subtotal").otherwise("chat")).otherwise("turn.completed")
    rows = table(spark, sf_dir, "conversations").select("role", record_kind(raw, scope).alias("kind"))
    return rows.groupBy("role", "kind").agg(F.count(F.lit(1)).alias("n"))


# Canonical JSON of a text, written out in SQL: quotes, backslashes, controls and non-ASCII escaped.
ESCAPED = r"""
array_to_string(list_transform(string_split(text, ''), lambda c:
  CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
       WHEN c = chr(9) THEN '\t' WHEN c <> '' AND (unicode(c) < 32 OR unicode(c) > 126)
       THEN '\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END), '')"""


@query(
    "canonical_json",
    f"""
SELECT conv_id, turn, '{{"a":[' || turn || ',1.5,null],"text":"' || {ESCAPED} || '","z":{{"role":"' || role || '","yes":true}}}}' AS canonical
FROM conversations""",
)
def canonical(spark, sf_dir):
    """A JSON text with its keys out of order and blanks between them."""
    loose = F.format_string(
        '{ "z" : {"yes": true, "role": "%s"},\n "text": %s, "a": [%d, 1.50, null] }',
        "role", F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1), "turn",
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", canonical_json(loose).alias("canonical"))


@query(
    "package_integrity",
    f"""
SELECT conv_id, turn, sha256('{{"output":"' || {ESCAPED} || '","passed":' || (role = 'assistant') || ',"turn":' || turn || '}}') AS integrity
FROM conversations""",
)
def integrities(spark, sf_dir):
    package = F.to_json(F.struct("turn", (F.col("role") == "assistant").alias("passed"), F.col("text").alias("output")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", package.alias("package"))
    return package_integrity(rows).drop("package")


@query(
    "json_at",
    """SELECT event_id, (props::JSON->>'k')::BIGINT AS inner_k, event_type AS second, NULL::VARCHAR AS nothing FROM events""",
)
def pointers(spark, sf_dir):
    doc = F.format_string('{"a/b": [%s, {"~": "%s"}]}', "props", "event_type")
    return spread(table(spark, sf_dir, "events")).select(
        "event_id",
        json_at(doc, "/a~1b/0/k").cast("long").alias("inner_k"),
        F.get_json_object(json_at(doc, "/a~1b/1"), "$['~']").alias("second"),
        json_at(doc, "/a~1b/2").alias("nothing"),
    )


def _tasks(spark, sf_dir):
    """A conversation is a suite, a turn is a task and its role the expected answer."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("task_id"), F.col("text").alias("instruction"),
        F.to_json(F.struct("turn", "role")).alias("expected"), F.col("role").alias("repo_text"),
    )


_CHARS = "length(text) + length('{\"role\":\"' || role || '\",\"turn\":' || turn || '}') + length(role)"


@query("work_size", f"SELECT conv_id, turn AS task_id, {_CHARS} AS work_chars FROM conversations")
def sizes(spark, sf_dir):
    return work_size(_tasks(spark, sf_dir)).select("conv_id", "task_id", "work_chars")


@query(
    "suite_size",
    f"SELECT conv_id, sum({_CHARS})::BIGINT AS work_chars, sum({_CHARS})::DOUBLE / 4 AS work_units FROM conversations GROUP BY conv_id",
)
def suites(spark, sf_dir):
    return suite_size(work_size(_tasks(spark, sf_dir)), ["conv_id"])


@query(
    "manifest",
    f"""
SELECT conv_id, sha256('[' || string_agg(
    '{{"check":"extract-json","expectedJson":{{"role":"' || role || '","turn":' || turn ||
    '}},"expectedKeys":["role","turn"],"id":"' || turn || '","mustInclude":null,"promptHash":"' || sha256(text) || '"}}',
    ',' ORDER BY turn) || ']') AS suite_hash,
  sum({_CHARS})::BIGINT AS work_chars, sum({_CHARS})::DOUBLE / 4 AS work_units, count(*) AS tasks
FROM conversations GROUP BY conv_id""",
)
def manifests(spark, sf_dir):
    return manifest(work_size(_tasks(spark, sf_dir)), ["conv_id"])


@query(
    "verify_manifest",
    """
SELECT d.doc_id AS id, CASE WHEN l.quality = 0 THEN 'missing' WHEN l.toxic = 1 THEN 'changed' ELSE 'ok' END AS verdict
FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT -1 - page_id, 'added' FROM pages""",
)
def verified(spark, sf_dir):
    """Recorded: the documents. Found: poor ones gone, toxic ones edited, and the pages besides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def hashed(df):
        return df.select(F.col("doc_id").alias("id"), content_hash("text").alias("hash"), character_count("text").alias("chars"))

    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").filter("coalesce(quality, 1) <> 0")
    edited = labelled.select("doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return verify_manifest(hashed(docs), hashed(edited.unionByName(pages)), "id", ["hash", "chars"])


@query(
    "manifest_rejects",
    """
SELECT conv_id, CASE WHEN turn % 5 <> 1 THEN turn END AS task_id,
  CASE turn % 5 WHEN 2 THEN '{"role":' WHEN 3 THEN '["' || role || '"]' ELSE '{"turn":' || turn || ',"role":"' || role || '"}' END AS expected
FROM conversations WHERE turn % 5 <> 0""",
)
def rejected(spark, sf_dir):
    """Tasks without id or instruction, with broken expected values, or with values that are no object."""
    fifth = F.col("turn") % 5
    tasks = _tasks(spark, sf_dir).withColumn("turn", F.col("task_id"))
    rows = tasks.withColumns({
        "expected": F.when(fifth == 2, '{"role":').when(fifth == 3, F.concat(F.lit('["'), F.get_json_object("expected", "$.role"), F.lit('"]'))).otherwise(F.col("expected")),
        "instruction": F.when(fifth == 4, F.lit(None)).otherwise(F.col("instruction")), "task_id": F.when(fifth == 1, F.lit(None)).otherwise(F.col("task_id")),
    })
    return manifest_rejects(rows, ["conv_id"])
