"""Agent output and verifier output: activity labels, first errors, test logs, reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import fixed_values as V
from ledgerline.functions.jsontext import parse
from ledgerline.functions.text import one_line, path_tail, strip
from ledgerline.operators.decode import clean, decode_text, explode_texts
from ledgerline.operators.usage import ATTEMPT_KEYS, stream_rank, whole_number

REPORT = (
    "ok boolean, reward int, failed int, passedTests array<string>, failedTests array<string>, "
    "details array<string>, errors array<string>, log array<string>, error string"
)

# --- activity labels --------------------------------------------------------------------------

class Limits(NamedTuple):
    """Characters of a label: of model text, of a tool's target and of other lines, and of a line that is noise."""

    said: int | None = None
    target: int | None = None
    line: int | None = None
    noise: int | None = None


# What an event offers for its label, in the order it is considered: the event itself, its content,
# the blocks of the content (each in the same way), and what is left of the event.
_FACTS = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("part", "kind", "sub", "tool", "said", "error")]
        + [T.StructField("failed", T.BooleanType())]
        + [T.StructField("targets", T.ArrayType(T.StringType()))]
    )
)


def _first(obj, *names):
    """First value under ``names`` that is not empty, zero, false or null."""
    return next((obj[n] for n in names if obj.get(n)), None) if isinstance(obj, dict) else None


def _text(value) -> str | None:
    return None if value is None else clean(str(value))


def _string(value) -> str | None:
    return clean(value) if isinstance(value, str) else None


def _tool(obj: dict) -> str | None:
    names = (obj.get(n) for n in ("tool_name", "toolName", "name", "tool"))
    own = next((n for n in names if isinstance(n, str) and n and n not in V.ACTORS), None)
    return _string(own or _first(_first(obj, "tool_call", "toolCall", "function"), "name", "tool"))


def _targets(obj: dict) -> list[str]:
    """What a tool works on, best first; files are marked by a leading slash."""
    arguments = _first(obj, "input", "arguments", "args")
    found = [(n, obj.get(n)) for n in V.OWN_TARGETS]
    found += [(n, arguments.get(n)) for n in V.ARGUMENT_TARGETS] if isinstance(arguments, dict) else []
    return [("/" if n in V.FILE_KEYS else " ") + clean(v) for n, v in found if isinstance(v, str)]


def _facts(event) -> Iterator[dict]:
    if not isinstance(event, dict):
        return
    base = {"kind": _text(_first(event, "type", "event", "kind")), "sub": _text(_first(event, "subtype", "status"))}
    message = _first(event, "message", "error")
    if isinstance(message, dict):  # one without a text of its own leaves the kind of event
        message = _first(message, "message", "error") or _first(event, "type", "event", "kind")
    yield base | {"part": "event", "tool": _tool(event), "targets": _targets(event), "error": _text(message)}
    content = _first(event, "content", "message")
    if isinstance(content, dict):
        said = _string(_first(content, "content", "text"))
        yield base | {"part": "content", "tool": _tool(content), "targets": _targets(content), "said": said}
        for block in content["content"] if isinstance(content.get("content"), list) else ():
            yield from _facts(block)
    reason = _first(event, "result", "errors", "error")
    reason = reason[0] if isinstance(reason, list) else reason
    failed = _first(event, "is_error", "isError") is not None
    yield base | {"part": "rest", "said": _string(event.get("text")), "failed": failed, "error": _text(reason)}


@F.pandas_udf(_FACTS)
def _event_facts(lines: pd.Series) -> pd.Series:
    def read(line):
        try:
            event = parse(line)
        except ValueError:
            return None
        return list(_facts(event[-1] if isinstance(event, list) and event else event))

    return lines.map(read, na_action="ignore").astype(object)


def _label(f: Column, limits: Limits) -> Column:
    low, blank = F.lower(f["kind"]), F.lit("")
    said = F.concat(F.lit("model "), one_line(f["said"], limits.said))
    # A target that is blank is passed over, whichever key it stood under.
    target = F.get(F.filter(f["targets"], lambda t: strip(F.substr(t, F.lit(2))) != ""), F.lit(0))
    target = F.when(F.startswith(target, F.lit("/")), path_tail(target)).otherwise(one_line(target, limits.target))
    tool = strip(F.concat(F.coalesce(f["tool"], F.lit("tool")), F.lit(" "), F.coalesce(target, blank)))
    error = F.concat(F.lit("cli error "), one_line(F.coalesce(f["error"], f["sub"], f["kind"]), limits.line))
    failure = F.concat(F.lit("cli error "), one_line(F.coalesce(f["error"], F.lit("is_error")), limits.line))
    return (
        F.when(
            f["part"] == "event",
            F.when(low.isin(V.ERROR_TYPES), error).when(f["tool"].isNotNull() | low.isin(V.TOOL_TYPES), tool),
        )
        .when(
            f["part"] == "content",
            F.when(f["tool"].isNotNull(), tool).when(low.isin(V.SPEECH_TYPES) & (strip(f["said"]) != ""), said),
        )
        .otherwise(
            F.when(low.isin(V.SPEECH_TYPES) & f["said"].isNotNull(), said)
            .when(low == "result", F.when(f["failed"], failure).otherwise(F.concat(F.lit("cli result "), F.coalesce(f["sub"], F.lit("done")))))
            .when(low == "system", F.concat(F.lit("cli "), F.coalesce(f["sub"], F.lit("system"))))
            .when(low.isin(V.TURN_EVENT_TYPES), F.concat(F.lit("cli "), f["kind"]))
        )
    )


def event_snippet(line, limits: Limits = Limits()) -> Column:
    """Label of an output line: a JSON event by its content (the last of a list), else the line itself.

    An error comes first, then a tool and its target, then model text, then results and turns. Nothing is cut
    unless ``limits`` says so; a plain line longer than ``limits.noise`` has no label.
    """
    line = strip(F.col(line) if isinstance(line, str) else line)
    is_json = line.rlike(r"^[{\[]")
    labels = F.transform(_event_facts(F.when(is_json, line)), lambda f: _label(f, limits))
    label = F.get(F.filter(labels, lambda s: s.isNotNull()), F.lit(0))
    noise = line.rlike(r"^(\x1b|[ .\-/|\\]*$)")
    if limits.noise is not None:
        noise = noise | (F.char_length(line) > limits.noise)
    return F.when(is_json, label).when(~noise, one_line(line, limits.line))


# --- first error and blocked runs -------------------------------------------------------------

_OUTCOME = T.StructType(
    [T.StructField("blob", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("type", "said", "reason", "payload_type", "payload_said")]
    + [T.StructField("is_error", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("tokens", "api_ms")]
)


def _count(value) -> int:
    """A count, fractions dropped; 0 for what is no finite number."""
    if isinstance(value, float):
        value = int(value) if math.isfinite(value) else 0
    return whole_number(value)


def _outcomes(text: str, whole: bool) -> Iterator[dict]:
    """Per top-level object that may report a failure: what it says."""
    for blob, (value, _) in enumerate(decode_text(text, whole)):
        if not isinstance(value, dict):
            continue
        payload = value["payload"] if isinstance(value.get("payload"), dict) else {}
        is_error = _first(value, "is_error", "isError") is not None
        kind, payload_type = _text(_first(value, "type")), _text(_first(payload, "type"))
        if not (is_error or kind in V.ERROR_TYPES or payload_type in V.ERROR_TYPES):
            continue
        said = _first(value, "result", "message", "error", "errors")
        said = _first(said, "message", "error") or said if isinstance(said, dict) else said
        usage = value["usage"] if isinstance(value.get("usage"), dict) else {}
        yield {
            "blob": blob, "type": kind, "is_error": is_error, "payload_type": payload_type,
            "said": _text(said[0] if isinstance(said, list) else said),
            "reason": _text(_first(value, "stop_reason", "stopReason")),
            "payload_said": _text(_first(payload, "message") or payload),
            "tokens": _count(_first(usage, "input_tokens", "inputTokens")),
            "api_ms": _count(_first(value, "duration_api_ms", "durationApiMs")),
        }


def read_outcomes(texts: DataFrame, keep: Sequence[str], whole: bool = True) -> DataFrame:
    """Every JSON object that reports a failure, with its message, reason, tokens and API time."""
    return explode_texts(texts, "text", list(keep), _OUTCOME, _outcomes, whole)


def _outcome_error(limit: int | None) -> Column:
    line = F.nullif(one_line(F.coalesce("said", "type"), limit), F.lit(""))
    with_reason = F.when(F.col("reason").isNull(), line).otherwise(F.concat(line, F.lit(" ("), "reason", F.lit(")")))
    own = F.when(F.col("is_error") | F.col("type").isin("error", "turn.failed"), with_reason)
    nested = F.when(F.col("payload_type").isin("error", "stream_error"), F.nullif(one_line("payload_said", limit), F.lit("")))
    return F.coalesce(own, nested)


def first_error(
    texts: DataFrame, keys: Sequence[str] = ATTEMPT_KEYS, whole: bool = True, limit: int | None = None
) -> DataFrame:
    """``keys`` plus ``error``: the first reported error, stderr before stdout, else the last line said.

    The streams of a key are one text. ``limit`` cuts the error to so many characters.

    One aggregate over two kinds of rows: errors found in JSON (``found``) and last lines (``said``).
    """
    keys = list(keys)
    placed = texts.withColumn("stream_rank", stream_rank(first="stderr"))
    part = ["file"] if "file" in texts.columns and "file" not in keys else []  # a stream may come in several files
    keep = [*keys, "stream_rank", *part, "seq"]
    found = read_outcomes(placed, keep, whole).select(*keep, "blob", _outcome_error(limit).alias("found"))
    said = placed.select(*keep, F.substring_index(strip("text"), "\n", -1).alias("said"))
    rows = found.filter("found is not null").unionByName(said.filter("said != ''"), allowMissingColumns=True)
    place = F.struct("stream_rank", *part, "seq", "blob")
    late = F.struct(-F.col("stream_rank"), *part, F.col("seq"))
    best = rows.groupBy(*keys).agg(
        F.min_by("found", F.when(F.col("found").isNotNull(), place)).alias("found"),
        F.max_by("said", F.when(F.col("said").isNotNull(), late)).alias("said"),
    )
    # What follows the last line feed may still hold rarer line ends; only the one text chosen is looked at.
    line = F.element_at(F.split("said", r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), -1)
    return best.select(*keys, F.coalesce("found", one_line(line, limit)).alias("error"))


def blocked_runs(texts: DataFrame, exits: DataFrame, keys: Sequence[str] = ATTEMPT_KEYS, whole: bool = True) -> DataFrame:
    """Keys of attempts that never reached the model: an error without tokens or API time, or a jail
    failure with a bad exit code. ``exits``: ``keys`` and ``exit_code``."""
    keys = list(keys)
    idle = read_outcomes(texts, keys, whole).filter("is_error and tokens = 0 and api_ms = 0").select(*keys)
    jailed = texts.filter(F.contains("text", F.lit("sandbox-exec:"))).select(*keys)
    bad_exit = exits.filter("exit_code != 0").select(*keys)
    return idle.unionByName(jailed.join(bad_exit, keys, "left_semi")).distinct()


# --- verifier output --------------------------------------------------------------------------


def parse_test_log(logs: DataFrame, log: str = "log", limit: int | None = None) -> DataFrame:
    """Add ``passedTests``, ``failedTests`` and ``details`` read from a verbose test log; ``limit`` details at most."""
    pattern, headers, raised = F.lit(V.TEST_RAN), F.lit(V.TEST_HEADER), F.lit(V.TEST_RAISED)
    text = F.coalesce(log, F.lit(""))
    tests = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("state")
    )
    out = logs.withColumn("_tests", tests)

    def named(*states: str) -> Column:
        hits = F.filter("_tests", lambda t: t["state"].isin(*states))
        return F.transform(hits, lambda t: t["name"])

    failed = named("FAIL", "ERROR")
    details = F.array_distinct(F.transform(F.regexp_extract_all(text, raised, F.lit(0)), strip))
    return out.withColumns(
        {
            "passedTests": named("ok"),
            "failedTests": F.when(F.size(failed) > 0, failed).otherwise(F.regexp_extract_all(text, headers, F.lit(1))),
            "details": details if limit is None else F.slice(details, 1, limit),
        }
    ).drop("_tests")


def parse_reports(texts: DataFrame, text: str = "text") -> DataFrame:
    """Report columns from report texts; a missing text or one that is no object counts as a failure."""
    parsed = F.from_json(text, REPORT)
    is_object = F.expr(f"schema_of_variant(try_parse_json(`{text}`)) like 'OBJECT<%'")
    keep = [c for c in texts.columns if c != text]
    rows = texts.withColumn("_r", F.when(is_object, parsed)).withColumn("_ok", F.coalesce(is_object, F.lit(False)))
    absent = F.when(F.col(text).isNull(), F.lit("no reward.json"))
    return rows.select(
        *keep,
        F.when(F.col("_ok"), F.col("_r.ok")).otherwise(False).alias("ok"),
        F.when(F.col("_ok"), F.col("_r.reward")).otherwise(0).alias("reward"),
        F.when(F.col("_ok"), F.col("_r.failed")).otherwise(1).alias("failed"),
        *[f"_r.{c}" for c in ("passedTests", "failedTests", "details", "errors", "log")],
        F.when(F.col("_ok"), F.col("_r.error")).otherwise(absent).alias("error"),
    )


def merge_report(reports: DataFrame, parsed: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """Reports with the lists they lack filled in from the parsed log, with ``limit`` errors at most."""
    lists = ["passedTests", "failedTests", "details"]
    seen = parsed.select(*by, *[F.col(c).alias(f"_{c}") for c in lists])
    rows = reports.join(seen, list(by), "left")
    from_log = {c: F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")) for c in lists}
    errors = from_log["failedTests"] if limit is None else F.slice(from_log["failedTests"], 1, limit)
    fill = F.when(F.col("failedTests").isNull(), errors)
    merged = rows.withColumns({"errors": F.coalesce("errors", fill), **{c: F.coalesce(c, from_log[c]) for c in lists}})
    return merged.drop(*[f"_{c}" for c in lists])
