"""Near duplicates by bottom-k sketches of one hash function, confirmed on whole shingle sets.

1. Each text becomes the set of its word shingles; the ``SKETCH`` smallest hashes are its sketch. Texts with
   the same set are one class from here on.
2. The sketch values are inverted. Two sets as alike as asked for share at least ``_least_shared`` values (but
   for a chance of about 1e-8), so each class is listed only under its rarest values, as many as make sure that
   two such classes meet in a list. Classes that meet none are single.
3. The whole sets of the others are laid out in one order, rare shingles first. Sets that are alike share a
   shingle among the first few, at places that leave room for the overlap needed; every list of such a shingle
   is first joined to its leader, links are contracted to components, and only entries that are in different
   components after that are paired. A group of any size so costs as many pairs as it has members.
4. A pair whose union sketch estimates far too little is dropped; the others are confirmed on whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WordHashes, arrow_map, components, shingles, space_words, written

SKETCH = 32
#: Chance of missing a pair at the very threshold through its sketches.
MISS = 2e-8
#: Ids that are sent to all executors when whole sets are fetched; above, the texts are shuffled.
BROADCAST_IDS = 200_000
#: Sets with more than this share of all rows, so at most as many as its inverse, are joined to their rows by broadcast.
HOT_SHARE = 1 / 1000


def _least_shared(percent: int) -> int:
    """The overlap of two sketches that pairs at the threshold fall short of with a chance below ``MISS``."""
    j, total = percent / 100, 0.0
    for shared in range(SKETCH + 1):
        total += math.comb(SKETCH, shared) * j**shared * (1 - j) ** (SKETCH - shared)
        if total >= MISS:
            return shared
    return SKETCH


def _sets(docs: DataFrame, key: str, text: str, size: int, whole: bool) -> DataFrame:
    """``(key, fp, n, hashes)``: the fingerprint and size of each set, and its sketch or all of it, sorted."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(space_words(t), size, hashes) for t in batch.column(1).to_pylist()]
        prints = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in found]
        kept = found if whole else [s[:SKETCH] for s in found]
        ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
        flat = np.concatenate(kept) if kept else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(prints, pa.string()), pa.array([len(s) for s in found], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
            ],
            names=["key", "fp", "n", "hashes"],
        )

    return arrow_map(rows, run, f"key {kind}, fp string, n long, hashes array<bigint>")


def _suspects(classes: DataFrame, percent: int) -> DataFrame:
    """Fingerprints of the classes that meet another one under a rare sketch value."""
    entries = classes.select("fp", "n", F.explode("hashes").alias("v"))
    often = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = entries.join(often, "v").groupBy("fp", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared")
    )
    # values that only this class has come first and list nothing: what is left of the prefix is cut from the others
    need = f"least({_least_shared(percent)}, ceil({percent} * n / 100))"
    left = F.expr(f"cast(greatest(0, size(shared) - {need} + 1) as int)")
    listed = shared.select("fp", F.explode(F.slice("shared", F.lit(1), left)).alias("e")).select("fp", "e.v")
    meet = listed.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    return listed.join(meet, "v").select("fp").distinct()


def _whole_sets(docs: DataFrame, key: str, text: str, size: int, classes: DataFrame, suspects: DataFrame) -> DataFrame:
    """``(fp, n, hashes)`` of the suspects, from the text of one document of each class; fp is the class's number."""
    ids = written(classes.join(suspects.withColumnRenamed("fp", "id"), "id").select(F.col("key").alias("__id"), "fp", "id"), "suspected")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select(key, text).join(ids.select("__id"), F.col(key).eqNullSafe(F.col("__id")), "left_semi")
    # a key may be repeated with other texts; the fingerprint tells which is meant
    found = _sets(chosen, key, text, size, whole=True).select("fp", "n", "hashes").join(ids.select("fp", "id"), "fp")
    found = written(found.select(F.col("id").alias("fp"), "n", "hashes"), "whole")
    rows, kinds = found.agg(F.count(F.lit(1)), F.count_distinct("fp")).first()
    if rows == kinds:  # no key is repeated with the same text
        return found
    return written(found.groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes")), "whole")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """``(x, fp, n, m, i)``: shingle x stands at place i of the set, whose first places hold its rarest shingles.

    m counts the shingles that other sets have too. Places beyond the prefix are left out, as are entries
    that leave too little room for the overlap with the smallest set in their list.
    """
    rows = sets.select("fp", "n", F.explode("hashes").alias("x"))
    often = rows.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    places = (
        rows.join(often, "x").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("s"))
        .withColumn("m", F.size("s").cast("long"))
        .where(f"100 * m >= {percent} * n")
        .withColumn("s", F.expr(f"slice(s, 1, cast(greatest(0, m - ceil({percent} * n / 100) + 1) as int))"))
        .select("fp", "n", "m", F.posexplode("s").alias("at", "e"))
        .select(F.col("e.x").alias("x"), "fp", "n", "m", F.expr("n - m + at").alias("i"))
    )
    lists = places.groupBy("x").agg(F.count("*").alias("c"), F.min("n").alias("n_min")).where("c > 1")
    room = f"ceil({percent} * (n + n_min) / {100 + percent})"
    return places.join(lists, "x").where(f"n - i >= {room} and m >= {room}").select("x", "fp", "n", "m", "i")


def _fits(percent: int):
    """Whether two entries of a list leave room for the overlap their sets need."""
    need = f"ceil({percent} * (p.n + q.n) / {100 + percent})"
    return F.expr(f"least(p.n - p.i, q.n - q.i) >= {need} and least(p.m, q.m) >= {need}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike: first by the estimate of their union sketch, then on whole sets."""
    side = lambda name: sets.select(F.col("fp").alias(name), F.col("hashes").alias(f"s{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    low = lambda name: F.slice(name, 1, SKETCH)
    union = F.slice(F.array_sort(F.array_union(low("sa"), low("sb"))), 1, SKETCH)
    seen = F.size(F.array_intersect(F.array_intersect(union, low("sa")), low("sb")))
    need = F.least(F.lit(_least_shared(percent)), F.ceil(F.lit(percent) * F.size(union) / 100))
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = F.lit(100) * shared >= F.lit(percent) * (F.size("sa") + F.size("sb") - shared)
    return both.where(F.when(seen >= need, alike).otherwise(False)).drop("sa", "sb")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` of all classes that are linked with another one."""
    index = written(_index(sets, percent), "index")
    pair = F.least("p.fp", "q.fp").alias("a"), F.greatest("p.fp", "q.fp").alias("b")
    leaders = index.groupBy("x").agg(F.min(F.struct("i", "fp", "n", "m")).alias("l")).select("x", "l.*")
    near = (
        index.alias("p").join(leaders.alias("q"), F.expr("p.x = q.x and p.fp <> q.fp") & _fits(percent))
        .select(*pair).distinct()
    )
    links = written(_confirmed(near, sets, percent), "links")
    roots = written(components(links), "roots")
    rooted = index.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = rooted.groupBy("x").agg(F.min("root").alias("u"), F.max("root").alias("w")).where("u <> w").select("x")
    rest = written(rooted.join(mixed, "x"), "index")
    if not rest.head(1):
        return roots
    across = (
        rest.alias("p").join(rest.alias("q"), F.expr("p.x = q.x and p.root < q.root") & _fits(percent))
        .groupBy(*pair).agg(F.min(F.struct("p.root", F.col("q.root").alias("other"))).alias("r"))
    )
    # links between components: only their roots are still to be joined
    more = written(_confirmed(across, sets, percent).select(F.col("r.root").alias("a"), F.col("r.other").alias("b")), "links")
    if not more.head(1):
        return roots
    joined = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.unionByName(more.select(F.explode(F.array("a", "b")).alias("node"), F.col("node").alias("root"))).distinct()
    return every.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """``(key, n_shingles, component)`` for each row: the smallest key among all documents that links reach.

    Two documents are linked if the intersection of their shingle sets is at least ``percent`` hundredths of
    the union. Words lie between ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle. Null, empty and blank texts have no shingles, are linked with nothing and keep their own key.
    Repeated rows are linked like other copies and appear as often as given. A null key is no smallest key
    unless its whole component has none. Columns other than key and text are not read. An empty table gives
    an empty result.
    """
    rows = written(_sets(docs, key, text, words, whole=False), "sketches")
    classes = rows.where("n > 0").groupBy("fp").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes")
    )
    # From here on classes go by numbers, which hold once written; a fingerprint is several times as long.
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    numbered = classes.select(F.col("id").alias("fp"), "n", "hashes")
    suspects = written(_suspects(numbered, percent), "suspects")
    sets = _whole_sets(docs, key, text, words, classes, suspects)
    roots = written(_links(sets, percent), "roots")
    named = roots.join(classes.select(F.col("id").alias("node"), "key", "fp"), "node")
    low = named.groupBy("root").agg(F.min("key").alias("low"))
    linked = named.join(low, "root").select("fp", "low")
    hot = (F.col("copies") > F.lit(HOT_SHARE) * rows.count()).alias("hot")
    of_class = classes.select("fp", F.col("key").alias("least"), hot).join(linked, "fp", "left")
    of_class = written(of_class.select("fp", F.coalesce("low", "least").alias("component"), "hot"), "components")
    # sets that a large share of the rows have are few; they go to the rows, not the rows to them
    few = F.broadcast(of_class.where("hot").drop("hot"))
    others = rows.join(few, "fp", "left_anti").join(of_class.where("not hot").drop("hot"), "fp", "left")
    return rows.join(few, "fp").unionByName(others).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"),
    )


def without_near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each component, the one with the smallest key, with all its columns and no new ones.

    A key that is not its component's smallest goes with all its rows; of rows that repeat a kept key and its
    text one stays. Rows without words stay, but for such repeats.
    """
    found = written(near_duplicates(docs, key=key, text=text, words=words, percent=percent), "found")
    gone = found.where(~F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("__id")).distinct()
    repeated = found.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(F.col(key).alias("__id"))
    left = docs.join(gone, F.col(key).eqNullSafe(F.col("__id")), "left_anti")
    if not repeated.head(1):
        return left
    same = F.col(key).eqNullSafe(F.col("__id"))
    once = left.join(repeated, same, "left_semi").dropDuplicates([key, text])
    return left.join(repeated, same, "left_anti").unionByName(once)
