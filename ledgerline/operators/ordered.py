"""Window functions over keys of any size.

``Window.partitionBy(key)`` sorts each key in one task, which is the best plan for all keys but those that
hold a large share of the table. ``ordered`` looks for keys of more than ``max_rows`` rows. Only their rows are
laid out by range over (key, order), so that a hot key spans many chunks, and their window functions run per chunk
with a carry row from the chunks before. Only the first key of a chunk can continue from an earlier one, so the
carries never exceed the number of chunks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import scratch_path, staged

MAX_ROWS = 4_000_000
CHUNK = "_chunk"


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame | None:
    """The keys with more than ``max_rows`` rows, or null if there are none.

    Reads the key columns only and combines before the shuffle. There are at most rows / ``max_rows`` such keys.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows)
    hot = staged(sizes.select(*keys), "hot")
    return hot if hot.head(1) else None


def by_heat(rows: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all other keys, and those of the hot ones."""
    names = [f"_hot_{k}" for k in keys]
    table = hot.toDF(*names)
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return rows.join(table, same, "left_anti"), rows.join(table, same, "left_semi")


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> DataFrame:
    """Write ``df`` as a table of chunks of about ``max_rows`` rows, contiguous in (key, order).

    The table fixes the chunk numbers: the bounds of a range shuffle come from a sample and would
    differ from one job to the next.
    """
    chunks = max(2, math.ceil(2 * df.count() / max_rows))
    path = scratch_path(df.sparkSession, "chunks")
    (
        df.repartitionByRange(chunks, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id())
        .write.partitionBy(CHUNK)
        .parquet(path)
    )
    schema = T.StructType([*df.schema.fields, T.StructField(CHUNK, T.IntegerType())])
    return df.sparkSession.read.schema(schema).parquet(path)


class Ordered:
    """Rows in ``order`` within ``keys``, as parts that are chunked or not; see ``ordered``."""

    def __init__(self, parts: list[tuple[DataFrame, bool]], keys: Sequence[str], order: Sequence[str]):
        self.parts, self.keys, self.order = parts, list(keys), list(order)

    def _window(self, chunked: bool):
        cut = [CHUNK] if chunked else []
        return Window.partitionBy(*self.keys, *cut).orderBy(*self.order)

    def _each(self, step) -> Ordered:
        return Ordered([(step(df, chunked), chunked) for df, chunked in self.parts], self.keys, self.order)

    def lag(self, name: str, value: Column) -> Ordered:
        """Add ``name``: ``value`` of the row before, null on the first row of a key."""
        return self._neighbour(name, value, ahead=False)

    def lead(self, name: str, value: Column) -> Ordered:
        """Add ``name``: ``value`` of the row after, null on the last row of a key."""
        return self._neighbour(name, value, ahead=True)

    def _neighbour(self, name: str, value: Column, ahead: bool) -> Ordered:
        shift = F.lead if ahead else F.lag

        def step(df: DataFrame, chunked: bool) -> DataFrame:
            if not chunked:
                return df.withColumn(name, shift(value).over(self._window(False)))
            boxed = df.withColumn("_box", F.struct(value.alias("v")))
            place = F.struct(*self.order)
            edge = boxed.groupBy(*self.keys, CHUNK).agg((F.min_by if ahead else F.max_by)("_box", place).alias("_edge"))
            across = Window.partitionBy(*self.keys).orderBy(CHUNK)
            carry = edge.select(*self.keys, CHUNK, shift("_edge").over(across).alias("_carry")).filter("_carry is not null")
            near = boxed.withColumn("_near", shift("_box").over(self._window(True)))
            out = near.join(carry, [*self.keys, CHUNK], "left").withColumn(name, F.coalesce("_near", "_carry")["v"])
            return out.drop("_box", "_near", "_carry")

        return self._each(step)

    def running_sum(self, name: str, value: Column) -> Ordered:
        return self._running(name, value, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)))

    def running_max(self, name: str, value: Column) -> Ordered:
        return self._running(name, value, F.max, F.greatest)

    def _running(self, name, value, total, join) -> Ordered:
        before = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

        def step(df: DataFrame, chunked: bool) -> DataFrame:
            to_here = self._window(chunked).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            out = df.withColumn(name, total(value).over(to_here))
            if not chunked:
                return out
            sums = df.groupBy(*self.keys, CHUNK).agg(total(value).alias("_total"))
            carry = sums.select(*self.keys, CHUNK, total("_total").over(before).alias("_carry")).filter("_carry is not null")
            out = out.join(carry, [*self.keys, CHUNK], "left")
            return out.withColumn(name, join(F.col(name), F.col("_carry"))).drop("_carry")

        return self._each(step)

    def rows(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [df.drop(CHUNK) for df, _ in self.parts])


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS) -> Ordered:
    """Lay ``df`` out for window functions."""
    hot = hot_keys(df, keys, max_rows)
    if hot is None:
        return Ordered([(df, False)], keys, order)
    cold, warm = by_heat(df, keys, hot)
    return Ordered([(cold, False), (range_chunks(warm, keys, order, max_rows), True)], keys, order)
