"""JSON change logs applied to a table of documents.

A document is the carried-in state of a fold over its operations, so neither a long change log nor
a hot document is gathered in memory; only the document itself is.

Flat documents whose operations only add or replace entries at the top need no fold: the last writer of each entry
stands, which is one aggregate that combines before the shuffle, without Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.jsontext import descend, index, parse, steps
from ledgerline.operators.folds import Fold, final_states
from ledgerline.operators.ordered import MAX_ROWS
from ledgerline.session import staged

_GOOD, _BAD = "=", "!"


def _add(parent, step, value):
    if isinstance(parent, list):
        parent.insert(len(parent) if step == "-" else index(step, len(parent) + 1), value)
    elif isinstance(parent, dict):
        parent[step] = value
    else:
        raise ValueError("parent holds no values")


def _place(parent, step):
    """Key or position of an existing value in its parent."""
    descend(parent, [step])
    return index(step, len(parent)) if isinstance(parent, list) else step


class Patches(Fold):
    """State: ``[document, error]``. After an error nothing more is applied."""

    def __init__(self, op: str, path: str, value: str):
        self.inputs = (op, path, value)

    def fresh(self):
        return [None, "no such document"]

    def step(self, state, op, path, value):
        if state[1] is None:
            try:
                state[0] = self._apply(state[0], op, steps(path), value)
            except ValueError as error:
                state[1] = str(error)
        return ()

    def _apply(self, doc, op, path, value):
        value = None if value is None else parse(value)
        if op == "test":
            if descend(doc, path) != value:
                raise ValueError("test failed")
            return doc
        if op not in ("add", "replace", "remove"):
            raise ValueError(f"unsupported op {op}")
        if not path:
            if op == "remove":
                raise ValueError("cannot remove the root")
            return value
        parent, step = descend(doc, path[:-1]), path[-1]
        if op == "add":
            _add(parent, step, value)
        elif op == "replace":
            parent[_place(parent, step)] = value
        else:
            del parent[_place(parent, step)]
        return doc

    def dump(self, state):
        return _BAD + state[1] if state[1] is not None else _GOOD + json.dumps(state[0])

    def load(self, text):
        if text.startswith(_BAD):
            return [None, text[1:]]
        try:
            return [parse(text[1:]), None]
        except ValueError:
            return [None, "document is no JSON"]


#: Values and keys that are written the same after they were read: whole numbers, short decimals, plain strings.
_VALUE = r'(?:null|true|false|0|-?[1-9][0-9]*|-?(?:0|[1-9][0-9]{0,8})[.](?:[0-9]{0,3}[1-9])|"[ !#-\\[\\]-~]*")'
_KEY = r"[ !#-\[\]-~]*"
_ENTRY = rf'"({_KEY})": ?({_VALUE})(?=[,}}])'
_FLAT = rf'^\{{(?:{_ENTRY}(?:, ?{_ENTRY})*)?\}}$'


def _flat(doc: Column) -> Column:
    """Whether a document is an object of such values, without repeated keys."""
    keys = F.regexp_extract_all(doc, F.lit(_ENTRY), F.lit(1))
    return F.coalesce(doc.rlike(_FLAT) & (F.size(keys) == F.size(F.array_distinct(keys))), F.lit(False))


def flat_patches(docs: DataFrame, ops: DataFrame, doc_id: str = "doc_id", doc: str = "doc", seq: str = "seq") -> DataFrame:
    """``(doc_id, state, plain)`` of every flat document: its text or error as the fold writes it, and whether all its
    operations add or replace entries at the top with plain values. Only then the state holds.

    A replace of an entry that nothing has added is an error, the earliest of which stands.
    """
    # ~ and / are escapes of pointers
    plain = (
        F.col("op").isin("add", "replace") & F.col("path").rlike(rf"^/{_KEY}$") & ~F.substr("path", F.lit(2)).rlike("[~/]")
        & F.coalesce("value", F.lit("null")).rlike(f"^{_VALUE}$") & F.col(seq).isNotNull()
    )
    by_entry = ops.groupBy(doc_id, "path").agg(
        F.min(seq).alias("first"), F.min_by("op", seq).alias("first_op"), F.max_by(F.struct("value"), seq).alias("last"),
        F.bool_and(F.coalesce(plain, F.lit(False))).alias("plain"),
    )
    change = F.struct("first", F.substr("path", F.lit(2)).alias("key"), "first_op", F.coalesce("last.value", F.lit("null")).alias("value"))
    by_doc = by_entry.groupBy(doc_id).agg(
        F.bool_and("plain").alias("plain"), F.array_sort(F.collect_list(F.when(F.col("plain"), change))).alias("changes")
    )
    rows = docs.filter(_flat(F.col(doc))).select(doc_id, F.col(doc).alias("_doc")).join(by_doc, doc_id, "left")
    part = lambda n: F.regexp_extract_all("_doc", F.lit(_ENTRY), F.lit(n))
    rows = rows.withColumns({"keys": part(1), "values": part(2), "changes": F.coalesce("changes", F.expr("filter(array(named_struct("
        f"'first', cast(null as {dict(ops.dtypes)[seq]}), 'key', '', 'first_op', '', 'value', '')), x -> false)"))})
    new = F.filter("changes", lambda c: ~F.array_contains("keys", c["key"]))
    lost = F.filter(new, lambda c: c["first_op"] == "replace")
    written = F.map_from_arrays(F.transform("changes", lambda c: c["key"]), F.transform("changes", lambda c: c["value"]))
    rows = rows.withColumns({"new": new, "lost": F.get(lost, F.lit(0))["key"], "written": written})
    entry = lambda key, value: F.concat(F.lit('"'), key, F.lit('": '), value)
    old = F.zip_with("keys", "values", lambda k, v: entry(k, F.coalesce(F.try_element_at("written", k), v)))
    text = F.concat(F.lit("{"), F.array_join(F.concat(old, F.transform("new", lambda c: entry(c["key"], c["value"]))), ", "), F.lit("}"))
    state = F.when(F.col("lost").isNotNull(), F.concat(F.lit(_BAD + "nothing at "), "lost")).otherwise(F.concat(F.lit(_GOOD), text))
    return rows.select(doc_id, state.alias("state"), F.coalesce("plain", F.lit(True)).alias("plain"))


def apply_patches(
    docs: DataFrame, ops: DataFrame, doc_id: str = "doc_id", doc: str = "doc", seq: str = "seq", max_rows: int = MAX_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, doc)`` after all operations of ``ops(doc_id, seq, op, path, value)``, and
    ``(doc_id, error)`` of the documents whose operations did not all apply.

    Where there are flat documents, those that ``flat_patches`` can tell are taken from there; the fold gets the others.
    """
    if docs.filter(_flat(F.col(doc)) & F.col(doc_id).isNotNull()).head(1):
        told = staged(flat_patches(docs.filter(F.col(doc_id).isNotNull()), ops, doc_id, doc, seq).filter("plain").drop("plain"), "told")
        good, bad = _outcomes(told, doc_id, doc)
        more = apply_folded(docs.join(told, doc_id, "left_anti"), ops.join(told, doc_id, "left_anti"), doc_id, doc, seq, max_rows)
        return good.unionByName(more[0]), bad.unionByName(more[1])
    return apply_folded(docs, ops, doc_id, doc, seq, max_rows)


def _outcomes(ends: DataFrame, doc_id: str, doc: str) -> tuple[DataFrame, DataFrame]:
    body, good = F.substr("state", F.lit(2)), F.startswith("state", F.lit(_GOOD))
    return ends.filter(good).select(doc_id, body.alias(doc)), ends.filter(~good).select(doc_id, body.alias("error"))


def apply_folded(
    docs: DataFrame, ops: DataFrame, doc_id: str = "doc_id", doc: str = "doc", seq: str = "seq", max_rows: int = MAX_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``apply_patches`` by the fold alone."""
    start = docs.select(doc_id, F.concat(F.lit(_GOOD), F.col(doc)).alias("state"))
    # A missing path is not the root.
    ops = ops.withColumn("path", F.coalesce("path", F.lit("missing")))
    # Both results are read from here, so the fold runs once.
    ends = staged(final_states(ops, [doc_id], [seq], Patches("op", "path", "value"), start, max_rows), "patched")
    return _outcomes(ends, doc_id, doc)
