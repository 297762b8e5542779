"""JSON values out of messy text, one Arrow pass over a table of texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.session import short_batches

_START = re.compile(r"[\[{]")


def decode_text(text: str, whole: bool = True) -> Iterator[tuple[object, str]]:
    """The JSON values in a text, one at a time, and where each was found: ``whole``, ``item``, ``line`` or ``data``.

    A text that is JSON as a whole yields that value, or its items if it is a list. Otherwise each
    line is searched for values until one does not parse; ``data`` marks lines with that prefix.
    """
    decoder = json.JSONDecoder(parse_constant=lambda name: None)
    text = text.strip()
    if whole and text:
        try:
            value = decoder.decode(text)
        except (ValueError, RecursionError):
            pass
        else:
            yield from ((item, "item") for item in value) if isinstance(value, list) else [(value, "whole")]
            return
    for line in map(str.strip, text.splitlines()):
        where = "data" if line.startswith("data:") else "line"
        start = _START.search(line)
        while start:
            try:
                value, end = decoder.raw_decode(line, start.start())
            except (ValueError, RecursionError):
                break
            yield value, where
            start = _START.search(line, end)


def clean(text: str) -> str:
    """``text`` without the lone surrogates that JSON escapes can spell and UTF-8 cannot."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def explode_texts(
    texts: DataFrame, text: str, keep: Sequence[str], made: T.StructType, rows_of: Callable[[str, bool], Iterator[dict]], whole: bool
) -> DataFrame:
    """Rows made from each text by ``rows_of``, with the kept columns repeated."""
    short_batches(texts.sparkSession)
    schema = T.StructType([texts.schema[c] for c in keep] + made.fields)
    arrow, made_arrow = to_arrow_schema(schema), to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            source, rows = [], []
            for i, value in enumerate(batch.column(text)):
                if not value.is_valid:
                    continue
                for row in rows_of(value.as_py(), whole):
                    source.append(i)
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pack(batch, source, rows)
                        source, rows = [], []
            yield pack(batch, source, rows)

    def pack(batch, source, rows):
        kept = batch.select(keep).take(pa.array(source, pa.int32()))
        new = pa.RecordBatch.from_pylist(rows, schema=made_arrow)
        return pa.RecordBatch.from_arrays([*kept.columns, *new.columns], schema=arrow)

    return texts.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


BLOB = T.StructType(
    [
        T.StructField("blob", T.IntegerType()),
        T.StructField("sse", T.BooleanType()),
        T.StructField("json", T.StringType()),
    ]
)



def blobs_of(text: str, whole: bool) -> Iterator[dict]:
    for blob, (value, where) in enumerate(decode_text(text, whole)):
        yield {"blob": blob, "sse": where == "data", "json": json.dumps(value)}


def extract_blobs(
    texts: DataFrame, keep: Sequence[str], text: str = "text", whole: bool = True
) -> DataFrame:
    """Every JSON value found in the texts: ``keep`` plus ``blob`` (its number), ``sse`` and ``json``."""
    return explode_texts(texts, text, list(keep), BLOB, blobs_of, whole)
