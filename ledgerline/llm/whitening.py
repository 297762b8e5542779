"""Whitening of embeddings by a weighted covariance over distinct vectors.

1. Entries become integers; equal vectors are counted, so everything that follows sees each of them once.
2. Each task centres its distinct vectors by the integer part of the mean, weights them by their counts and
   multiplies: one matrix product per batch. The entries are exact integers, added up by Spark; what the mean
   has beyond its integer part is taken off the totals. No order of tasks changes a digit.
3. The covariance, square in the number of dimensions and of no other size, is decomposed on the driver. Tasks
   project each distinct vector once; a second weighted product over the projections checks them.
4. Rows are joined to their vector by a digest. Vectors that hold more than a thousandth of all rows, so fewer than
   a thousand, are broadcast; the others are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written

SCALE, SHIFT = 64, 1_000_000
#: Integers stay exact in products and sums of them; an entry beyond is set to it.
LARGEST = 2.0**40
#: A vector with more than this share of the rows is broadcast, so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
_LONG = 2**63 - 1


def as_integers(vector: str, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` per entry; null for null vectors and null, NaN or infinite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(
        vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))) + shift
    )
    return F.when(~bad, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _product(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``z' diag(w) z`` of integers, exact: in doubles while these hold every partial sum."""
    most = float(np.abs(z).max(initial=0))
    if most * most * float(w.sum()) < 2.0**53:
        f = z.astype(np.float64)
        return ((f * w[:, None].astype(np.float64)).T @ f).astype(np.int64)
    big = z.astype(object)
    return (big * w[:, None].astype(object)).T @ big


def _cells(total: np.ndarray) -> pa.RecordBatch:
    """The upper half of a matrix, or a vector, as rows."""
    if total.ndim == 1:
        i = j = np.arange(len(total))
    else:
        i, j = np.triu_indices(len(total))
    values = total if total.ndim == 1 else total[i, j]
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(int(v)) for v in values], pa.string())],
        names=["i", "j", "v"],
    )


def _added(parts: DataFrame) -> list[tuple[int, int, int]]:
    """Integer cells of all tasks added up: as many rows as the matrix has cells."""
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [(r.i, r.j, int(r.v)) for r in sums.collect()]


def _first_moment(distinct: DataFrame, size: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
            if float(np.abs(x).max(initial=0)) * float(w.sum()) < 2.0**62:
                total += (x * w[:, None]).sum(axis=0).astype(object)
            else:
                total += (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
        yield _cells(total)

    sums = [0] * size
    for i, _, v in _added(distinct.select("x", "w").mapInArrow(run, "i int, j int, v string")):
        sums[i] = v
    return sums


def _second_moment(distinct: DataFrame, centre: np.ndarray) -> np.ndarray:
    """``sum w (x - centre)(x - centre)'`` as exact integers."""
    size = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            total += _product(_matrix(batch.column(0)) - centre, batch.column(1).to_numpy()).astype(object)
        yield _cells(total)

    found = np.zeros((size, size), object)
    for i, j, v in _added(distinct.select("x", "w").mapInArrow(run, "i int, j int, v string")):
        found[i, j] = found[j, i] = v
    return found


def _components(moment: np.ndarray, n: int, rest: list[int], most: int):
    """``(vectors as columns, eigenvalues, trace)`` of the covariance, largest first, those without variance left out.

    ``rest / n`` is the mean less the integer centre.
    """
    size = len(rest)
    cov = np.array([[(n * int(moment[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)], float)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    real = values > max(values[0], 0) * size * np.finfo(float).eps
    kept = np.flatnonzero(real)[:most]
    return vectors[:, kept] * signs[kept], values[kept], float(np.trace(cov))


def _whitened(distinct: DataFrame, n: int, centre, rest, vectors, values) -> DataFrame:
    """``fp``, ``w``, ``deviation`` and the projections ``y`` of each distinct vector."""
    less, scale = np.array([r / n for r in rest]), 1 / np.sqrt(values)

    def deviations(z: np.ndarray) -> list[str]:
        if (float(np.abs(z).max(initial=0)) * n + n) ** 2 * z.shape[1] < 2.0**62:
            d = n * z - np.array(rest, np.int64)
            return [str(v) for v in (d * d).sum(axis=1).tolist()]
        d = n * z.astype(object) - np.array(rest, object)
        return [str(v) for v in (d * d).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(0)) - centre
            y = ((z - less) @ vectors) * scale
            ends = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2), batch.column(1), pa.array(deviations(z), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel(), pa.float64())),
                ],
                names=["fp", "w", "deviation", "y"],
            )

    return distinct.select("x", "w", "fp").mapInArrow(run, "fp string, w long, deviation string, y array<double>")


def _identity_error(white: DataFrame, n: int, count: int) -> float:
    """The largest absolute entry of the projections' covariance, less one on its diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            y, w = _matrix(batch.column(0)), batch.column(1).to_numpy()[:, None].astype(float)
            total += (y * w).T @ y
            first += (y * w).sum(axis=0)
        i, j = np.triu_indices(count)
        at = np.arange(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, at], pa.int32()), pa.array(np.r_[j, np.full(count, -1)], pa.int32()),
             pa.array(np.r_[total[i, j], first], pa.float64())], names=["i", "j", "v"])

    found = white.select("y", "w").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    cells = {(r.i, r.j): r.v / n for r in found.collect()}
    return max(
        abs(v - cells[i, -1] * cells[j, -1] - (i == j)) for (i, j), v in cells.items() if j >= 0
    )


def whiten(
    table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 32, weights: str = "counts",
    scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` per row and component, from 1.

    Entries c become ``floor(scale * c) + shift``. ``weights="counts"`` fits on all vectors, ``"one"`` on each
    distinct vector once; n is the weight of the fit, ``deviation`` the sum over dimensions of ``(n x - S)^2``, exact
    (null where it does not fit a long).

    Null vectors and those with null, NaN or infinite entries take no part, nor do empty vectors and those of
    another length than the most frequent one (the longer of equally frequent ones). Entries beyond 2^40 in
    size after scaling are set to 2^40. Repeated rows appear as often as given, with null keys too. Components
    without variance (fewer distinct vectors than dimensions, constant dimensions) are left out; equal eigenvalues may
    take any directions between them, the same for all rows. Other columns are not read. An empty table, or one
    whose vectors are all the same, gives an empty result.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    spark, kind = table.sparkSession, dict(table.dtypes)[key]
    empty = spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, "
                                      "explained double, identity_error double")
    rows = table.select(F.col(key).alias("key"), as_integers(vector, scale, shift).alias("x")).where("size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    if not sizes:
        return empty
    size, total = sizes[0]
    digest = F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), 256)
    rows = written(rows.where(F.size("x") == size).withColumn("fp", digest), "vectors")
    distinct = rows.groupBy("fp").agg(F.any_value("x").alias("x"), F.count(F.lit(1)).alias("rows"))
    distinct = written(distinct.withColumn("w", F.col("rows") if weights == "counts" else F.lit(1).cast("long")), "distinct")
    n = total if weights == "counts" else distinct.count()
    sums = _first_moment(distinct, size)
    centre, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    vectors, values, trace = _components(_second_moment(distinct, centre), n, rest, components)
    if not len(values):
        return empty
    white = written(_whitened(distinct, n, centre, rest, vectors, values), "whitened")
    error = _identity_error(white, n, len(values))
    made = white.select("fp", F.expr(f"if(length(deviation) < 19 or (length(deviation) = 19 and deviation <= '{_LONG}'), "
                                     "cast(deviation as bigint), null)").alias("deviation"), "y")
    hot = distinct.where(F.col("rows") > HOT_SHARE * total).select("fp")
    few = F.broadcast(hot)
    here = rows.select("key", "fp")
    joined = here.join(few, "fp", "left_anti").join(made, "fp").unionByName(
        here.join(F.broadcast(made.join(few, "fp", "left_semi")), "fp")
    )
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return joined.select(
        F.col("key").alias(key), "deviation", F.posexplode("y").alias("at", "whitened")
    ).select(
        key, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
