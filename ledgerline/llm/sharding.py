"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets are split.

The bytes of all rows are summed by hash prefix, a few bits at a time; a bucket that fits the limit is a shard,
the others are split on their next bit. The directory is a table of buckets and is joined to the rows by the
bits they start with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import running_start, written

#: Bytes of text in a shard.
SHARD_BYTES = 32 << 20
HASH_BITS = 60
#: Bits that one pass over the oversized buckets adds.
STEP_BITS = 12
#: Directory entries that are sent to all executors; a larger directory is joined by a shuffle.
BROADCAST_BUCKETS = 100_000


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``(depth, prefix, shard_bytes)`` of the buckets that share out the rows of ``sizes(h, size)``.

    The root, depth 0, is one bucket. A bucket whose rows have one hash cannot be split and stays at depth 60.
    """
    found, rows, base = [], sizes, 0
    while True:
        top = min(base + STEP_BITS, HASH_BITS)
        cell = F.expr(f"shiftright(h, {HASH_BITS - top})")
        cells = written(rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size")), "buckets")
        sums = (
            cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix"))
            .agg(F.sum("size").alias("shard_bytes"))
        )
        # split off an oversized bucket: both halves stand below it
        split = sums.where(f"shard_bytes > {limit} and depth < {top}").select(
            F.expr("depth + 1").alias("depth"),
            F.explode(F.expr("array(2 * prefix, 2 * prefix + 1)")).alias("prefix"),
        )
        if base == 0:
            split = split.unionByName(split.sparkSession.sql("select 0 as depth, 0L as prefix"))
        ends = sums.where(f"shard_bytes <= {limit} or depth = {HASH_BITS}")
        found.append(written(ends.join(split, ["depth", "prefix"]), "directory"))
        over = cells.where(f"size > {limit}").select("cell")
        if top == HASH_BITS or not over.head(1):
            break
        rows, base = rows.withColumn("cell", cell).join(over, "cell", "left_semi").drop("cell"), top
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def shards(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, prefix: str = ""
) -> DataFrame:
    """All columns of ``docs`` and ``shard``, ``depth``, ``n_bytes`` and ``shard_bytes``, named with ``prefix``.

    ``shard`` is the bucket's bits as text, empty while one bucket holds all. Shards hold at most ``limit``
    bytes of text (UTF-8); a single row above the limit has a shard of its own. Rows of one key stay together;
    if they exceed the limit, overflow shards ``bits+1``, ``bits+2``, ... take what the first cannot. Null and
    empty texts have no bytes but a shard. A null key is hashed as the empty text. Columns of ``docs`` that
    have the name of a result column are replaced. An empty table stays empty.
    """
    names = [f"{prefix}{n}" for n in ("shard", "depth", "n_bytes", "shard_bytes")]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sizes = written(docs.select(hash_bits(F.col(key)).alias("h"), size.alias("size")), "sizes")
    table = directory(sizes, limit)
    found = table.agg(F.count("*"), F.min("depth"), F.max(F.when(F.col("shard_bytes") > limit, 1))).first()
    least = found[1] or 0
    table = table.select(
        F.expr(f"shiftright(prefix, depth - {least})").alias("__cell"), F.col("depth").alias("__depth"),
        F.expr(f"shiftleft(prefix, {HASH_BITS} - depth)").alias("__low"),
        F.expr(f"shiftleft(prefix + 1, {HASH_BITS} - depth)").alias("__high"), F.col("prefix").alias("__prefix"),
        F.col("shard_bytes").alias("__sum"),
    )
    if found[0] <= BROADCAST_BUCKETS:
        table = F.broadcast(table)
    rows = kept.withColumns({"__h": hash_bits(F.col(key)), "__size": size})
    rows = rows.withColumn("__at", F.expr(f"shiftright(__h, {HASH_BITS - least})"))
    rows = rows.join(table, F.expr("__at = __cell and __h >= __low and __h < __high"))
    bits = F.expr("if(__depth = 0, '', lpad(conv(__prefix, 10, 2), __depth, '0'))")
    if found[2]:
        rows = _with_overflow(rows, limit)
        bits = F.concat(bits, F.expr("if(__page = 0, '', concat('+', __page))"))
    return rows.select(
        *(F.col(f"`{c}`") for c in kept.columns), bits.alias(names[0]), F.col("__depth").cast("int").alias(names[1]),
        F.col("__size").alias(names[2]), F.col("__sum").alias(names[3]),
    )


def _with_overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Adds ``__page``, and gives pages their own bytes, where the rows of one hash exceed the limit.

    The rows are numbered by their place in a written table, so that equal rows have places too.
    """
    fits = rows.where(f"__sum <= {limit}").withColumn("__page", F.lit(0).cast("long"))
    over = written(
        rows.where(f"__sum > {limit}").withColumns(
            {"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}
        ),
        "overflow",
    )
    # rows are put where they begin; the longest row of the key is kept free for the one that ends a page
    longest = over.groupBy("__h").agg(F.max("__size").alias("__longest"))
    placed = running_start(over, ["__h"], [F.col("__row")], F.col("__part"), F.col("__size"), "__begin").join(longest, "__h")
    room = F.expr(f"greatest(1, {limit} - __longest)")
    placed = placed.withColumn("__page", F.floor(F.col("__begin") / room).cast("long"))
    sums = placed.groupBy("__h", "__page").agg(F.sum("__size").alias("__sum"))
    return fits.unionByName(
        placed.drop("__sum", "__part", "__row", "__begin", "__longest").join(sums, ["__h", "__page"]).select(*fits.columns)
    )


def write_shards(sharded: DataFrame, path: str, *, shard: str = "shard") -> None:
    """A folder per shard, each written by one task: shards are bounded, so tasks are."""
    sharded.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)


def shard_digest(sharded: DataFrame, key: str = "doc_id") -> DataFrame:
    return sharded.select(key, "shard", "depth", "n_bytes", "shard_bytes")
