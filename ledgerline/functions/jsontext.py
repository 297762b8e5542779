"""JSON held in text: parsing, canonical form, entries, pointers.

Parsing happens in Arrow batches because the rules are those of Python's ``json`` (last duplicate
key wins, nothing may follow the value). What is done with the parsed values is column work.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDEX = re.compile(r"0|[1-9][0-9]*")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse(text):
    """The value of a JSON text; raises ValueError whatever is wrong with it."""
    try:
        return json.loads(text)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error


def dump(value) -> str:
    """Canonical JSON: sorted keys, ASCII only, no blanks."""
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def equal_form(value):
    """A value whose canonical JSON is the same for all values that compare equal."""
    if isinstance(value, bool) or (isinstance(value, float) and value.is_integer()):
        return int(value)
    if isinstance(value, list):
        return [equal_form(v) for v in value]
    if isinstance(value, dict):
        return {k: equal_form(v) for k, v in value.items()}
    return value


def _map(texts: pd.Series, fn) -> pd.Series:
    def safe(text):
        try:
            return fn(text)
        except ValueError:
            return None

    return texts.map(safe, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return _map(texts, lambda t: dump(parse(t)))


def canonical_json(text) -> Column:
    """Canonical form of a JSON text, null if it is not JSON."""
    return _canonical(_col(text))


def integrity(text) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(text), 256)


@F.pandas_udf(T.StringType())
def _first_object(candidates: pd.Series) -> pd.Series:
    def first(texts):
        for text in texts:
            try:
                value = parse(text.strip())
            except ValueError:
                continue
            if isinstance(value, dict):
                return json.dumps(value)
        return None

    return candidates.map(first, na_action="ignore").astype(object)


def extract_json_object(text) -> Column:
    """The first JSON object found in a text: in a code fence, the whole text, or the outermost braces."""
    text = _col(text)
    fenced = F.when(F.contains(text, F.lit("```")), F.regexp_extract(text, r"(?is)```(?:json)?(.*?)```", 1))
    opens, closes = F.instr(text, "{"), F.char_length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((opens > 0) & (closes > opens), F.substring(text, opens, closes - opens + 1))
    candidates = F.filter(F.array(fenced, text, braces), lambda c: F.contains(c, F.lit("{")))
    return _first_object(F.when(F.size(candidates) > 0, candidates))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _entries(texts: pd.Series) -> pd.Series:
    def top(text):
        value = parse(text)
        if not isinstance(value, dict):
            return None
        return {
            k.encode("utf-8", "replace").decode(): str(v).lower() if isinstance(v, bool) else dump(equal_form(v))
            for k, v in value.items()
        }

    return _map(texts, top)


def object_entries(text) -> Column:
    """Top-level entries of a JSON object as a map of JSON values; null if it is no object."""
    return _entries(_col(text))


def decoded_string(value: Column) -> Column:
    """The text of a JSON string value."""
    return F.try_parse_json(value).cast("string")


def steps(pointer: str) -> list[str]:
    """Unescaped steps of a JSON pointer; raises ValueError if it does not start at the root."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("path must start with /")
    return [part.replace("~1", "/").replace("~0", "~") for part in pointer.split("/")[1:]]


def index(step: str, size: int) -> int:
    """Position named by an array step, which must lie below ``size``."""
    if not _INDEX.fullmatch(step):
        raise ValueError("array index must be a whole number")
    if int(step) >= size:
        raise ValueError("array index out of range")
    return int(step)


def descend(value, path: list[str]):
    """The value at the end of a path; raises ValueError where it leads nowhere."""
    for step in path:
        if isinstance(value, list):
            value = value[index(step, len(value))]
        elif isinstance(value, dict) and step in value:
            value = value[step]
        else:
            raise ValueError("nothing at " + step)
    return value


@F.pandas_udf(T.StringType())
def _at(texts: pd.Series, pointers: pd.Series) -> pd.Series:
    def one(text, pointer):
        if text is None or pointer is None:
            return None
        try:
            return json.dumps(descend(parse(text), steps(pointer)))
        except ValueError:
            return None

    return pd.Series([one(t, p) for t, p in zip(texts, pointers)], dtype=object)


def json_at(text, pointer) -> Column:
    """JSON of the value a pointer names, null where it names nothing."""
    return _at(_col(text), pointer if isinstance(pointer, Column) else F.lit(pointer))
