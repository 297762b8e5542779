"""A mix of sources by target weights, laid out by a low-discrepancy schedule.

Each source's documents are shuffled by hash and cut into blocks of equal words. Slot n of the schedule belongs
to the source in whose share of the unit interval the point n * golden ratio (mod 1) lies; the k-th slot of a
source takes its k-th block, beginning again after the last. Any stretch of the mix so holds the sources close
to their shares. A source whose slots fall short by the schedule's discrepancy gets the missing ones at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import running_start, written
from ledgerline.llm.sharding import HASH_BITS, hash_bits

WEIGHTS = (5, 2, 1)
#: The mix has so many hundredths of the words of all documents, a source at most so many hundredths of its own.
MIX_PERCENT, MOST_PERCENT = 150, 200
BLOCK_WORDS = 256
#: The fractional part of the golden ratio, in 2^-32: slots step through the unit interval by it.
STEP = 2654435769


def n_words(text: str):
    """The number of runs without ASCII white space; null counts 0."""
    return F.coalesce(F.size(F.expr(rf"regexp_extract_all(`{text}`, '[^\\x20\\x09-\\x0D]+', 0)")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target, quota)`` from ``(source, source_size)``, a row per source.

    Sources weigh 5, 2, 1, 5, ... by code point, null last. Shares follow the weights; a source stops at its
    most, and what it leaves is shared among the others by weight again until none is above. That ends where
    the sources that stop are those whose most, by weight, is least, so running sums find it without rounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")).cast("long")
    rows = sizes.withColumn("w", weight).withColumn("most", F.expr(f"source_size * {MOST_PERCENT}"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            # in hundredths of words: what is left to share when all before this source have stopped
            "left": F.sum("source_size").over(every) * MIX_PERCENT - F.coalesce(F.sum("most").over(before), F.lit(0)),
            "w_left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("stops", F.expr("most * w_left <= left * w"))
    # the first source that doesn't stop sets the level for all from there on
    rows = rows.withColumn("level", F.max(F.when(~F.col("stops"), F.struct("w_left", "left"))).over(every))
    shared = F.expr("(level.left * w) / cast(100 * level.w_left as double)")
    rows = rows.withColumn("target", F.when(F.col("stops"), F.col("most") / F.lit(100.0)).otherwise(shared))
    return rows.select("source", "source_size", "target", F.floor("target").cast("long").alias("quota"))


def _plan(sizes: DataFrame) -> DataFrame:
    """Targets with the number of blocks and slots of each source and where its slots begin among all."""
    rows = targets(sizes).withColumn(
        "blocks", F.expr(f"cast(ceil(source_size / {BLOCK_WORDS}) as long)")
    ).withColumn(
        "slots",
        F.expr(f"if(source_size = 0, 0, (quota div source_size) * blocks "
               f"+ cast(ceil((quota % source_size) / {BLOCK_WORDS}) as long))"),
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    return rows.withColumn("s", F.row_number().over(by_name)).withColumn(
        "low", F.coalesce(F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )


def _piece(rows: int) -> int:
    """Rows in a piece of a running total: as many pieces as rows in each, once there are enough."""
    return max(256, math.isqrt(rows))


def schedule(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """``(n, s, rank)``: slot n of the mix is slot ``rank`` of source ``s``."""
    total = plan.agg(F.sum("slots")).first()[0] or 0
    cells = 1 << 12
    slots = spark.range(total).select(
        F.col("id").alias("n"),
        F.expr(f"cast(floor((((id % {1 << 32}) * {STEP}) % {1 << 32}) / {float(1 << 32)} * {total}) as long)").alias("at"),
    ).withColumn("cell", F.expr(f"cast(floor(at / {max(total, 1)} * {cells}) as int)"))
    reach = plan.where("slots > 0").select(
        "s", "low", (F.col("low") + F.col("slots")).alias("high"),
        F.explode(
            F.expr(f"sequence(cast(floor(low / {max(total, 1)} * {cells}) as int), "
                   f"cast(floor((low + slots - 1) / {max(total, 1)} * {cells}) as int))")
        ).alias("cell"),
    )
    dealt = slots.join(reach, "cell").where("at >= low and at < high").select("n", "s")
    piece = _piece(total)
    ranked = running_start(dealt, ["s"], [F.col("n")], F.expr(f"n div {piece}"), F.lit(1), "rank")
    ranked = written(ranked.join(plan.select("s", "slots"), "s").where("rank < slots").select("n", "s", "rank"), "slots")
    have = ranked.groupBy("s").agg(F.count("*").alias("have"))
    short = plan.join(have, "s", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    late = short.select("s", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank"))
    return ranked.unionByName(late.select((F.lit(total) + F.col("rank") * 1_000_000 + F.col("s")).alias("n"), "s", "rank"))


def _placed(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's shuffled order, and the plan of the sources."""
    rows = written(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"),
            hash_bits(F.col(key)).alias("h"), F.md5(F.col(text).cast("binary")).alias("mark"),
        ),
        "sizes",
    )
    plan = written(_plan(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "plan")
    bits = max(0, (rows.count() // _piece(rows.count())).bit_length())
    named = plan.select(F.col("source").alias("__source"), "s", "source_size", "target", "quota", "blocks", "slots")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    order = [F.col("h"), F.col("key"), F.col("size"), F.col("mark")]
    return running_start(rows, ["s"], order, F.expr(f"shiftright(h, {HASH_BITS - bits})"), F.col("size"), "start"), plan


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix: ``(n, key, source, first, last, size, start, source_size, target)`` rows, slot by slot.

    Slot n takes words ``first`` to ``last`` (exclusive) of the document. Documents of which nothing is taken
    have one row with null ``n``, so every document is there. Null and empty texts have no words and are never
    taken. A null source is a source of its own, and so is the empty text. Repeated rows are documents of their
    own. Only key, text and source are read. An empty table gives an empty mix.
    """
    rows, plan = _placed(docs, key, text, source)
    last = F.expr(f"(start + size - 1) div {BLOCK_WORDS}")
    pieces = rows.withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {BLOCK_WORDS}"), last)))
    )
    slots = schedule(docs.sparkSession, plan).join(plan.select("s", "blocks", "quota", "source_size"), "s").select(
        "n", "s", F.expr("rank % blocks").alias("block"),
        # the last slot of a source ends with its quota
        F.expr(f"(rank % blocks) * {BLOCK_WORDS} + least({BLOCK_WORDS}, quota - (rank div blocks) * source_size "
               f"- (rank % blocks) * {BLOCK_WORDS})").alias("stop"),
    )
    joined = pieces.join(slots, ["s", "block"], "left")
    first = F.expr(f"greatest(start, block * {BLOCK_WORDS}) - start")
    end = F.expr(f"least(start + size, (block + 1) * {BLOCK_WORDS}, stop) - start")
    return joined.select(
        "n", F.col("key").alias(key), F.col("source").alias(source), first.alias("first"),
        F.greatest(first, end).alias("last"), "size", "s", "start", "h", "mark", "source_size", "target",
    )


def taken(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, the words that the mix takes of it, repeats counted."""
    words = F.sum(F.when(F.col("n").isNotNull(), F.col("last") - F.col("first")).otherwise(0))
    return mixed.groupBy(key, "size", "s", "start", "h", "mark", "source_size", "target").agg(words.alias("taken")).select(
        key, "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Whole documents, each as often as the mix takes its first word, with all columns and no new ones.

    Documents without words are not taken. Rows that agree in key, source and text are taken together.
    """
    rows = mix(docs, key=key, text=text, source=source)
    names = [F.col(key).alias("__key"), F.col(source).alias("__source"), F.col("mark").alias("__mark")]
    # documents of one text that differ in their place are repeated rows
    copies = rows.groupBy(*names).agg(
        F.count_if(F.col("n").isNotNull() & (F.col("first") == 0) & (F.col("last") > 0)).alias("__copies"),
        (F.min("start") < F.max("start")).alias("__repeated"),
    )
    copies = written(copies.where("__copies > 0"), "copies")
    same = (
        F.col(key).eqNullSafe(F.col("__key")) & F.col(source).eqNullSafe(F.col("__source"))
        & F.md5(F.col(text).cast("binary")).eqNullSafe(F.col("__mark"))
    )
    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.join(copies, same)
    if copies.where("__repeated").head(1):
        again = found.where("__repeated").dropDuplicates(["__key", "__source", "__mark"])
        found = found.where("not __repeated").unionByName(again)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return found.select(*kept, times.alias("__time")).select(*kept)
