"""Ordered folds: operators whose answer for a row depends on their answers before it.

A fold sees the rows of a key in order, keeps a small state and adds columns to each row. Spark
shuffles by key, sorts (spilling as needed) and streams Arrow batches through the fold, so memory
is bounded by the state.

A key above ``max_rows`` is not left to one task. The rows of such keys are laid out in range chunks; the
fold of a chunk needs the state its key had at the end of the chunk before. Often that state can be
told from the chunk itself, since every fold has moments that wipe out the past (``forgets``). Such
chunks are resolved in one parallel pass; the rest follow in rounds, each chunk being a task of its
own, and a last pass adds the columns everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.operators.ordered import CHUNK, MAX_ROWS, by_heat, hot_keys, range_chunks
from ledgerline.session import scratch_path, staged

CARRY = "_state"
_FIRST = "_data_row"


class Fold:
    """One key's running state. Subclasses are small, picklable and know nothing of Spark."""

    inputs: Sequence[str] = ()
    outputs: Sequence[T.StructField] = ()
    #: The input that holds the time. Rows without one change nothing and get nulls.
    timed: int | None = None

    def fresh(self):
        raise NotImplementedError

    def step(self, state, *values) -> tuple:
        """Advance ``state`` in place by one row; return the values of ``outputs``."""
        raise NotImplementedError

    def dump(self, state) -> str:
        raise NotImplementedError

    def load(self, text: str):
        raise NotImplementedError

    def stale_at(self, state) -> int | None:
        """Time from which ``state`` is as good as a fresh one; null if that cannot be told."""
        return None

    def watcher(self):
        """A callable fed the same values as ``step``; true once the earlier past cannot matter."""
        return lambda *values: False


def _columns(batch: pa.RecordBatch, names: Sequence[str]):
    return zip(*(batch.column(name).to_pylist() for name in names)) if names else None


def _emit(fold: Fold, keys: list[str], schema: pa.Schema, keep: list[str]):
    """mapInArrow body: the rows with the fold's columns added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, nothing = None, None, (None,) * len(fold.outputs)
        for batch in batches:
            made = []
            for key, carry, values in zip(
                _columns(batch, keys), batch.column(CARRY).to_pylist(), _columns(batch, fold.inputs)
            ):
                if key != current or state is None:
                    current, state = key, fold.fresh()
                if carry is not None:
                    state = fold.load(carry)
                    made.append(nothing)
                elif fold.timed is not None and values[fold.timed] is None:
                    made.append(nothing)
                else:
                    made.append(fold.step(state, *values))
            new = list(zip(*made)) if made else [()] * len(fold.outputs)
            arrays = [batch.column(name) for name in keep]
            arrays += [pa.array(col, schema.field(f.name).type) for col, f in zip(new, fold.outputs)]
            out = pa.RecordBatch.from_arrays(arrays, schema=schema)
            yield out.filter(batch.column(CARRY).is_null())

    return run


def _states(fold: Fold, keys: list[str], schema: pa.Schema):
    """mapInArrow body: one row per key with its last state and whether it stands on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, sure, watch = None, None, False, None

        def row():
            return pa.RecordBatch.from_pylist(
                [dict(zip(keys, current)) | {CARRY: fold.dump(state), "_sure": sure}], schema=schema
            )

        for batch in batches:
            for key, carry, values in zip(
                _columns(batch, keys), batch.column(CARRY).to_pylist(), _columns(batch, fold.inputs)
            ):
                if key != current or state is None:
                    if state is not None:
                        yield row()
                    current, state, sure, watch = key, fold.fresh(), False, fold.watcher()
                if carry is not None:
                    state, sure = fold.load(carry), True
                elif fold.timed is None or values[fold.timed] is not None:
                    fold.step(state, *values)
                    sure = sure or watch(*values)
        if state is not None:
            yield row()

    return run


def _with_state_rows(df: DataFrame, keys: list[str], state_in: DataFrame | None) -> DataFrame:
    rows = df.withColumn(CARRY, F.lit(None).cast("string")).withColumn(_FIRST, F.lit(1))
    if state_in is None:
        return rows
    carried = state_in.select(*keys, F.col("state").alias(CARRY), F.lit(0).alias(_FIRST))
    return rows.unionByName(carried, allowMissingColumns=True)


def _run_states(rows: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField(CARRY, T.StringType()), T.StructField("_sure", T.BooleanType())])
    needed = [*dict.fromkeys([*keys, _FIRST, CARRY, *order, *fold.inputs])]
    laid = rows.select(*needed).repartition(*keys).sortWithinPartitions(*keys, _FIRST, *order)
    return laid.mapInArrow(_states(fold, keys, to_arrow_schema(schema)), schema)


def _run_emit(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, keep: list[str]) -> DataFrame:
    schema = T.StructType([rows.schema[c] for c in keep] + list(fold.outputs))
    laid = rows.repartition(*keys).sortWithinPartitions(*keys, _FIRST, *order)
    return laid.mapInArrow(_emit(fold, keys, to_arrow_schema(schema), keep), schema)


def _chunk_starts(rows: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """State rows for every chunk that continues a key.

    Bounds, successors and states are small tables by chunk, joined to the rows; every round appends the states
    that it has found. Only whether a round found any reaches the driver.
    """
    key, by_chunk = F.struct(*keys), Window.orderBy(CHUNK)
    edges = rows.groupBy(CHUNK).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    edges = edges.withColumns({"_prev": F.lag(CHUNK).over(by_chunk), "_end": F.lag("hi").over(by_chunk)})
    before = F.when(F.col("_end").eqNullSafe(F.col("lo")), F.col("_prev"))
    # A chunk's last key is all that the next one needs; it stands alone if the key began in this chunk.
    began = F.col("before").isNull() | ~F.col("lo").eqNullSafe(F.col("hi"))
    links = staged(edges.withColumn("before", before).withColumn("began", began).select(CHUNK, "before", "began"), "links")
    needed = links.select(F.col("before").alias(CHUNK)).filter(f"{CHUNK} is not null").join(links, CHUNK)

    def tails(part: DataFrame) -> DataFrame:
        ends = _run_states(part, [CHUNK, *keys], order, fold)
        last = ends.groupBy(CHUNK).agg(F.max(key).alias("k"), F.max_by(F.struct(CARRY, "_sure"), key).alias("s"))
        return last.select(CHUNK, "k.*", "s.*")

    def carried(chunks: DataFrame) -> DataFrame:
        """The states of the chunks before ``chunks`` as first rows of ``chunks``."""
        states = known().withColumnRenamed(CHUNK, "before")
        return chunks.select(CHUNK, "before").join(states, "before").select(CHUNK, *keys, CARRY, F.lit(0).alias(_FIRST))

    def known() -> DataFrame:
        return rows.sparkSession.read.schema(found.schema).parquet(path)

    path = scratch_path(rows.sparkSession, "states")
    alone = tails(rows.join(needed.select(CHUNK), CHUNK, "left_semi")).join(needed.select(CHUNK, "began"), CHUNK)
    found = alone.filter("began or _sure").select(CHUNK, *keys, CARRY)
    found.write.parquet(path)
    while True:
        ready = staged(carried(needed.join(known(), CHUNK, "left_anti")), "ready")
        if not ready.head(1):
            return carried(links.filter("before is not null"))
        part = rows.join(ready.select(CHUNK), CHUNK, "left_semi").unionByName(ready, allowMissingColumns=True)
        tails(part).select(CHUNK, *keys, CARRY).write.mode("append").parquet(path)


def _by_size(rows: DataFrame, df: DataFrame, keys: list[str], order: list[str], max_rows: int | None, fold: Fold):
    """``(rows of other keys, chunked rows of hot keys with their states)``; the second is null without hot keys."""
    hot = hot_keys(df, keys, max_rows) if max_rows is not None else None
    if hot is None:
        return rows, None
    cold, warm = by_heat(rows, keys, hot)
    chunks = range_chunks(warm, [*keys, _FIRST], order, max_rows)
    return cold, chunks.unionByName(_chunk_starts(chunks, keys, order, fold), allowMissingColumns=True)


def keyed_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    state_in: DataFrame | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """``df`` plus the columns of ``fold``. ``state_in(keys…, state)`` continues an earlier run."""
    keys, order = list(keys), list(order)
    rows = _with_state_rows(df, keys, state_in)
    cold, chunks = _by_size(rows, df, keys, order, max_rows, fold)
    out = _run_emit(cold, keys, order, fold, df.columns)
    return out if chunks is None else out.unionByName(_run_emit(chunks, [CHUNK, *keys], order, fold, df.columns))


def pruned_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, decide, group: Sequence[str] = (), max_rows: int = MAX_ROWS
) -> DataFrame:
    """``keyed_fold`` for folds most of whose answers windows can tell: only the rows left open reach Python.

    ``decide`` adds ``_open`` (rows that the fold must answer), ``_fed`` (those and the rows that the answers depend on),
    the columns of ``fold`` for all that are not open, and ``group``: what the fold is keyed by besides ``keys``. It works
    within a key, so keys of more than ``max_rows`` rows go to the fold as they are.
    """
    keys, order, group = list(keys), list(order), list(group)
    hot = hot_keys(df, keys, max_rows)
    cold, warm = (df, None) if hot is None else by_heat(df, keys, hot)
    names = [f.name for f in fold.outputs]
    told = decide(cold)
    done = told.filter(~F.col("_open")).select(*df.columns, *names)
    rest = keyed_fold(told.filter("_fed").select(*df.columns, "_open", *group), [*keys, *group], order, fold, None, None)
    out = done.unionByName(rest.filter("_open").select(*df.columns, *names))
    return out if warm is None else out.unionByName(keyed_fold(warm, keys, order, fold, None, max_rows))


def final_states(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    state_in: DataFrame | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """``(keys…, state)`` after the last row of each key: the ``state_in`` of a later run.

    ``max_rows=None`` leaves every key to one task, for folds whose state cannot be handed on.
    """
    keys, order = list(keys), list(order)
    rows = _with_state_rows(df, keys, state_in)
    cold, chunks = _by_size(rows, df, keys, order, max_rows, fold)
    out = _run_states(cold, keys, order, fold).select(*keys, F.col(CARRY).alias("state"))
    if chunks is None:
        return out
    ends = _run_states(chunks, [CHUNK, *keys], order, fold)
    return out.unionByName(ends.groupBy(*keys).agg(F.max_by(CARRY, CHUNK).alias("state")))
