"""Helpers that the operators share: tokens, hashes, scratch tables, running totals, components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows that go to a Python worker at once: texts are long, so batches are short.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` by batch, with batches short enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Other batches, to Python and from Parquet, for what is run (not only planned) inside."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there, and a lost executor
    costs no work above it. ``options`` are those of the writer."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept up to a number of words."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(a: np.ndarray) -> np.ndarray:
    """Each 64-bit number through a bijection that spreads its bits."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.int64)
    one = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = min(size, len(words))
    total = mixed(one[: len(one) - n + 1] + np.uint64(n))
    for step in range(1, n):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + one[step : len(one) - n + 1 + step])
    return np.unique(total.view(np.int64))


def running_start(df: DataFrame, keys: list[str], order: list[Column], cell: Column, value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the keys, in the order of ``cell`` and then ``order``.

    No window spans a key: rows are summed by (keys, cell), the few cell totals are accumulated per key, and
    a second window runs within each cell. ``cell`` must grow with the order and cut every key into pieces.
    Keys and cell are not null.
    """
    rows = df.withColumns({"__piece": cell, "__value": value})
    by_cell = rows.groupBy(*keys, "__piece").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.withColumn("__start", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inner = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(starts, [*keys, "__piece"]).select(*(F.col(f"`{c}`") for c in rows.columns), "__start")
    return joined.withColumn(
        out, F.col("__start") + F.coalesce(F.sum("__value").over(inner), F.lit(0))
    ).drop("__piece", "__value", "__start")


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, root)``: every linked node with the smallest node it can reach.

    Alternating stars, each round written to the shared folder; minima are combined before the shuffle, so
    a node with very many links is no hot key. Links stay on the executors.
    """
    now, mark = edges.select("a", "b").where("a <> b"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        seen = Observation()  # counted while it is written
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = written(new.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), "links")
        mark, before = seen.get, mark
        if mark == before:
            found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
