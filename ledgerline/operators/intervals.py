"""Points matched to the intervals they lie in, as an equi-join.

Time is cut into buckets of several widths, each ``FAN`` times the one below. An interval is covered by the widest
buckets that fit in it, at most 2 ``FAN`` of each width, and a point lies in one bucket of each. So both sides meet
under (keys, width, bucket), whether intervals last a second or years, and a pair meets once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The narrowest bucket, in the unit of the times, how many a wider one holds, and the number of widths.
NARROW, FAN, WIDTHS = 1 << 10, 1 << 6, 6
#: The end of an interval without one; times from ``-FOREVER`` to it can be matched.
FOREVER = 1 << 45


def _cover(start: str, end: str) -> Column:
    """Buckets ``(width, bucket)`` that hold ``[start, end)``, none twice; the narrowest may stand out at either end."""
    widths = [NARROW * FAN**k for k in range(WIDTHS)]
    lows = [f"floor({start} / {w})" if k == 0 else f"ceil({start} / {w})" for k, w in enumerate(widths)]
    highs = [f"ceil({end} / {w})" if k == 0 else f"floor({end} / {w})" for k, w in enumerate(widths)]
    parts = []
    for k in range(WIDTHS):
        run = lambda a, b, k=k: (
            f"if({a} < {b}, transform(sequence(cast({a} as bigint), cast({b} as bigint) - 1), "
            f"x -> named_struct('width', {k}, 'bucket', x)), cast(array() as array<struct<width: int, bucket: bigint>>))"
        )
        if k == WIDTHS - 1:
            parts.append(run(lows[k], highs[k]))
            continue
        inside = f"{lows[k + 1]} < {highs[k + 1]}"  # what wider buckets cover
        left, right = f"{lows[k + 1]} * {FAN}", f"{highs[k + 1]} * {FAN}"
        parts.append(f"if({inside}, concat({run(lows[k], left)}, {run(right, highs[k])}), {run(lows[k], highs[k])})")
    return F.expr(f"concat({', '.join(parts)})")


def within(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str = "start", end: str = "end"
) -> DataFrame:
    """Every point with every interval of its keys that it lies in: ``start <= at < end``, integer columns.

    A null end is none; a null start, an empty interval and a point without a time match nothing. Keys match by
    equality. The columns are those of both sides; they must differ but for the keys.
    """
    keys = list(keys)
    place = [F.struct(F.lit(k).alias("width"), F.floor(F.col(at) / (NARROW * FAN**k)).alias("bucket")) for k in range(WIDTHS)]
    left = points.where(F.col(at).between(-FOREVER, FOREVER - 1)).withColumn("_bucket", F.explode(F.array(*place)))
    bounds = {"_start": F.greatest(F.col(start), F.lit(-FOREVER)), "_end": F.least(F.coalesce(F.col(end), F.lit(FOREVER)), F.lit(FOREVER))}
    right = spans.where(F.col(start).isNotNull()).withColumns(bounds).withColumn("_bucket", F.explode(_cover("_start", "_end")))
    # Spark takes both sides for as small as they are without buckets, and would send them through the driver.
    joined = left.join(right.hint("merge"), [*keys, "_bucket"]).where((F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end")))
    return joined.drop("_bucket", "_start", "_end")
