"""Jaccard join of documents on word n-grams: a blocked, masked product of the document by n-gram matrix.

A row of the matrix is a distinct set of n-grams; the overlap of two sets is an entry of the matrix times its transpose.
That product is never formed whole:

1. Mask. The n-grams of a row are put in one global order. Two sets that are alike enough share an n-gram among the
   first few of both, as many as the sizes allow them to differ in, and at the first one they share both have room for
   the overlap that their sizes ask for. Entries outside that mask cannot reach the bound and are discarded unseen.
2. Product. Masked entries are dealt into tiles, a block of rows by a block of rows of bounded size; rows whose first
   shared n-gram is the same stand in the same block, as far as it holds them. A row goes to a tile once, however many
   entries it has there; the tile's n-grams get local numbers, and the overlaps of a row with
   others are gathered and added up over its nonzeros. The columns are taken in two blocks: first the heads of the rows,
   after which entries that the rest cannot lift to the bound are discarded, then whole rows for what is left.
3. What is asked for are the groups that links make. So each column of the mask first meets one of its rows per size
   band, the one with the fewest n-grams of its own, and a row takes only the ``HUBS`` of these that it meets most often, of which the ``BEST`` by their heads are
   compared whole. Links found are contracted, and a second product takes all masked entries between different groups
   that are left, long columns in pieces of bounded size. So a group of any size costs about as many entries as it has
   rows, and what the choice of hubs misses is still found.

The order puts n-grams that are frequent in one of ``SAMPLE`` documents last. It is fitted on that sample, bounded to
``FREQUENT`` n-grams, and changes only how many entries the mask has, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WordHashes, batch_rows, components, shingles, space_words, written

#: One of so many documents is sampled for the order of n-grams; those in ``OFTEN`` of them are frequent.
SAMPLE, OFTEN, FREQUENT = 32, 3, 500_000
#: Texts that are worked on at once; n-grams of a block of rows; rows of a piece of a long column.
TEXTS, BLOCK, PIECE = 256, 500_000, 256
HUBS, BEST = 6, 3
#: Hashes of words that a task keeps.
WORDS = 200_000
#: Rows of ids and a few numbers that are sent to all executors, at most about 40 MB; above, both sides are shuffled.
BROADCAST_IDS = 500_000
#: Sets with more than this share of all rows, so at most as many as its inverse, are joined to their rows by broadcast.
HOT_SHARE = 1 / 1000


def _arrays(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.concatenate(found) if found else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _print(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _word_hashes() -> WordHashes:
    hashes = WordHashes()
    hashes.LIMIT = WORDS
    return hashes


def _mapped(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each`` over few texts at a time, as they may be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                yield each(batch.slice(start, TEXTS))

    return rows.mapInArrow(run, schema)


def _sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``(fp, hashes)``: the n-grams of the texts as sorted 64-bit hashes, and their fingerprint. A text without any has
    no row, and a task lists equal texts once."""
    hashes = _word_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                found: dict[bytes, np.ndarray] = {}
                for t in batch.column(0).slice(start, TEXTS).to_pylist():
                    grams = shingles(space_words(t), size, hashes)
                    if len(grams) and (fp := _print(grams)) not in seen:
                        seen.add(fp)
                        found[fp] = grams
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), _arrays(list(found.values()))], names=["fp", "hashes"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "fp binary, hashes array<bigint>")


def _frequent(docs: DataFrame, key: str, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams frequent in the sample, sorted, and the power of two of how often they are there."""
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0)
    counts = _sets(some, text, size).select(F.explode("hashes").alias("x")).groupBy("x").count()
    top = counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "x").limit(FREQUENT)
    rows = np.array(sorted((r.x, int(r["count"]).bit_length()) for r in top.collect()), np.int64).reshape(-1, 2)
    return rows[:, 0].copy(), rows[:, 1].copy()


def _heads(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``(key, fp, n, head, power)``: fingerprint and size of each set, and its first n-grams in the global order with the
    frequency class of the last one."""
    often, power = _frequent(docs, key, text, size)
    hashes = _word_hashes()

    def head(s: np.ndarray) -> tuple[np.ndarray, int]:
        length = len(s) - -(-percent * len(s) // 100) + 1
        if not len(often) or not len(s):
            return s[:length], 0
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        rank = np.where(often[at] == s, power[at], 0)
        first = np.argsort(rank, kind="stable")[:length]
        return s[first], int(rank[first[-1]])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(space_words(t), size, hashes) for t in batch.column(1).to_pylist()]
        heads, powers = zip(*map(head, found))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(_print, found), pa.binary()), pa.array([len(s) for s in found], pa.int64()), _arrays(heads),
             pa.array(powers, pa.int32())],
            names=["key", "fp", "n", "head", "power"],
        )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _mapped(rows, each, f"key {dict(docs.dtypes)[key]}, fp binary, n long, head array<bigint>, power int")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table for a join: broadcast up to ``BROADCAST_IDS`` rows of a few numbers each, else shuffled."""
    return F.broadcast(table) if rows <= BROADCAST_IDS else table


def _mask(classes: DataFrame) -> DataFrame:
    """``(x, id, n, i, rows, block)``: n-gram x stands at place i of the order in row id, and in the heads of ``rows`` rows.

    The block of a row is that of its first n-gram here. Rows with the same one are split among blocks if they are more
    than a block holds.
    """
    entries = classes.select("id", F.col("n").cast("int").alias("n"), F.posexplode("head").alias("i", "x"))
    shared = classes.select(F.explode("head").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    mask = entries.join(shared, "x").withColumn("first", F.min_by("x", "i").over(Window.partitionBy("id")))
    mask = written(mask.select("x", "id", "n", "i", "rows", "first"), "mask")
    held = mask.where("x = first").groupBy("first").agg(F.sum("n").alias("cells"))
    total = held.agg(F.sum("cells")).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK))
    large = held.where(F.col("cells") > BLOCK).select("first", F.ceil(F.col("cells") / BLOCK).alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), "parts")).otherwise(F.lit(0))
    placed = mask.join(_small(large, blocks), "first", "left").withColumn(  # no more of them than blocks
        "block", F.pmod(F.xxhash64("first", part), F.lit(blocks))
    )
    return placed.drop("first", "parts")


def _fits(percent: int) -> Column:
    """Whether two rows that share an n-gram at these places have room for the overlap that their sizes need."""
    return F.expr(f"least(p.n - p.i, q.n - q.i) >= ceil({percent} * (cast(p.n as bigint) + q.n) / {100 + percent})")


def _tile(percent: int, whole: bool):
    """The product of a tile: its masked entries that reach the bound, or, from heads, those that still may."""

    def kept(overlap: np.ndarray, a: np.ndarray, b: int, rows: dict) -> np.ndarray:
        n, length = rows["n"], rows["length"]
        if whole:
            return 100 * overlap >= percent * (n[a] + n[b] - overlap)
        # the order is the same for all rows, so what the two heads do not show lies behind the one that ends first
        ends_first = (rows["power"][a] < rows["power"][b]) | ((rows["power"][a] == rows["power"][b]) & (rows["last"][a] < rows["last"][b]))
        rest = np.where(ends_first, n[a] - length[a], n[b] - length[b])
        return (100 + percent) * (overlap + rest) >= percent * (n[a] + n[b])

    def overlaps(entries, table):
        ids = table["id"].to_numpy()
        lists = table["hashes"].combine_chunks()
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        columns = np.unique(flat[starts[0]:starts[-1]], return_inverse=True)[1]
        starts = starts - starts[0]
        rows = {"n": table["n"].to_numpy(), "power": table["power"].to_numpy(), "length": np.diff(starts), "last": flat[lists.offsets.to_numpy()[1:] - 1]}
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, entries[side].to_numpy(), sorter=order)] for side in "ab")
        linked, shared = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        by_b = np.argsort(b, kind="stable")
        marked = np.zeros(int(columns.max(initial=-1)) + 1, np.int64)
        hubs, firsts = np.unique(b[by_b], return_index=True)
        for hub, first, last in zip(hubs, firsts, np.r_[firsts[1:], len(by_b)]):
            own = columns[starts[hub]:starts[hub + 1]]
            marked[own] = 1
            for begin in range(first, last, 1024):  # so many rows at a time
                here = by_b[begin:min(begin + 1024, last)]
                sizes = rows["length"][a[here]]
                ends = np.cumsum(sizes)
                places = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[a[here]], sizes)
                overlap = np.add.reduceat(marked[columns[places]], ends - sizes)
                linked[here], shared[here] = kept(overlap, a[here], hub, rows), overlap
            marked[own] = 0
        return entries.select(_ENTRY).append_column("shared", pa.array(shared)).filter(pa.array(linked))

    return overlaps


def _in_tiles(entries: DataFrame, rows: DataFrame, percent: int, whole: bool) -> DataFrame:
    """The entries ``(a, b, block_a, block_b, shared)`` that the product over ``rows`` (``id, n, hashes, power``) keeps."""
    ends = F.array(*[F.struct(F.col(c).alias("id")) for c in "ab"])
    needed = entries.select(F.col("block_a").alias("down"), F.col("block_b").alias("across"), F.inline(ends))
    needed = written(needed.distinct(), "needed")
    shipped = _small(needed, needed.count()).join(rows, "id")
    return entries.groupBy("block_a", "block_b").cogroup(shipped.groupBy("down", "across")).applyInArrow(
        _tile(percent, whole), "a long, b long, block_a long, block_b long, shared long"
    )


def _first(entries: DataFrame, by: str, most: int) -> DataFrame:
    """The entries of each row a with the largest numbers."""
    order = Window.partitionBy("a").orderBy(F.desc(by), "b")
    return entries.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select(*_ENTRY)


def _product(
    entries: DataFrame, best: int | None, docs: DataFrame, suspects: DataFrame, key: str, text: str, size: int, percent: int
) -> DataFrame:
    """The entries whose overlap reaches the bound: by heads first, then, of all or the ``best`` of each row a, from whole
    sets."""
    entries = written(entries.select(*_ENTRY), "entries")
    kept = _in_tiles(entries, suspects.select("id", "n", F.col("head").alias("hashes"), "power"), percent, False)
    entries = written(kept.select(*_ENTRY) if best is None else _first(kept, "shared", best), "entries")
    ids = written(entries.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    chosen = written(suspects.join(_small(ids, ids.count()), "id", "left_semi").select("id", F.col("key").alias("__key"), "fp", "n", "power"), "chosen")
    few = _small(chosen, chosen.count())
    texts = docs.join(few.select("__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    # a key may be repeated with other texts; the fingerprint tells which is meant
    sets = _sets(texts, text, size).join(few.select("id", "fp", "n", "power"), "fp")
    with batch_rows(docs.sparkSession, TEXTS):
        sets = written(sets.drop("fp"), "rows")
    return _in_tiles(entries, sets, percent, True).select("a", "b")


#: A masked entry: two rows and their blocks.
_ENTRY = ["a", "b", "block_a", "block_b"]


def _pair(a: str, b: str) -> list[Column]:
    return [F.col(f"{side}.{c}").alias(name) for c, names in (("id", "ab"), ("block", ("block_a", "block_b"))) for side, name in zip((a, b), names)]


def _links(classes: DataFrame, mask: DataFrame, product, percent: int) -> DataFrame:
    """``(id, root)`` of all rows that links lead to another from."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))) if percent < 100 else F.col("n")
    banded = mask.withColumn("band", band)
    # the row with the fewest rarer n-grams of its own is likest to the others
    first = banded.groupBy("x", "band").agg(F.min(F.struct("i", "id", "n", "block")).alias("q")).select("x", "band", "q.*")
    star = banded.alias("p").join(first.alias("q"), F.expr("p.x = q.x and p.band = q.band and p.id <> q.id") & _fits(percent))
    met = star.groupBy(*_pair("p", "q")).agg(F.count(F.lit(1)).alias("met"))
    links = written(product(_first(met, "met", HUBS), BEST), "links")
    roots = written(components(links).withColumnRenamed("node", "id"), "roots")
    rooted = mask.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("x").agg(F.min("root").alias("u"), F.max("root").alias("w")).where("u <> w").select("x")
    rest = written(rooted.join(mixed, "x"), "mask")
    # a column of r rows is cut into k pieces; the pair of pieces (s, t), s <= t, meets in one place
    pieces = F.expr(f"cast(ceil(rows / {PIECE}) as int)")
    cut = rest.withColumns({"k": pieces, "own": F.expr(f"pmod(xxhash64(id), ceil(rows / {PIECE}))").cast("int")})
    left = cut.withColumns({"s": F.col("own"), "t": F.explode(F.expr("sequence(own, k - 1)"))}).alias("p")
    right = cut.withColumns({"s": F.explode(F.expr("sequence(0, own)")), "t": F.col("own")}).alias("q")
    meet = F.expr("p.x = q.x and p.s = q.s and p.t = q.t and p.root <> q.root and (p.s < p.t or p.id < q.id)")
    both = left.join(right, meet & _fits(percent))
    ends = [F.struct(f"{side}.id", f"{side}.block") for side in "pq"]
    both = both.select(F.greatest(*ends).alias("p"), F.least(*ends).alias("q"))
    across = both.select(*_pair("p", "q")).distinct()
    more = written(product(across, None), "links")
    if not more.head(1):
        return roots
    end = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    bridges = more.join(end("a"), "a", "left").join(end("b"), "b", "left")
    bridges = bridges.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    joined = written(components(written(bridges, "links")), "roots")
    alone = joined.select(F.col("node").alias("id"), F.col("node").alias("root"))
    tops = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.unionByName(alone).distinct().join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def jaccard_join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """``(key, n_shingles, component)`` for each row: the smallest key among all documents that links reach.

    Two documents link when the intersection of their sets of word n-grams is at least ``percent`` hundredths of the
    union. Words lie between ASCII white space, A-Z lower-cased; a text of fewer words than an n-gram is one n-gram.
    Null, empty and blank texts have no n-grams, link with nothing and keep their own key. Ties at the bound link.
    Repeated rows and equal texts are one row of the matrix and appear as often as given; a key that is repeated with
    other texts takes part with each. A null key is no smallest key unless its whole component has none. Texts of any
    length are read whole. Columns other than key and text are not read. An empty table gives an empty result.
    """
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be in 1..100 and words positive")
    with batch_rows(docs.sparkSession, TEXTS):
        rows = written(_heads(docs, key, text, words, percent), "heads")
    classes = rows.where("n > 0").groupBy("fp").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("head").alias("head"), F.any_value("power").alias("power")
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # ids hold once written
    mask = written(_mask(classes), "mask")
    ids = written(mask.select("id").distinct(), "ids")
    suspects = written(classes.join(_small(ids, ids.count()), "id", "left_semi"), "suspects")
    product = lambda entries, best: _product(entries, best, docs, suspects, key, text, words, percent)
    roots = written(_links(classes, mask, product, percent), "roots")
    named = roots.join(classes.select("id", "key", "fp"), "id")
    low = named.groupBy("root").agg(F.min("key").alias("low"))
    linked = named.join(low, "root").select("fp", "low")
    of_class = classes.select("fp", F.col("key").alias("least"), "copies").join(linked, "fp", "left").select(
        "fp", F.coalesce("low", "least").alias("component"), "copies"
    )
    # sets that a large share of the rows have are few; they go to the rows, not the rows to them
    hot = F.col("copies") > F.lit(HOT_SHARE) * rows.count()
    of_class = written(of_class.withColumn("hot", hot).drop("copies"), "components")
    few = F.broadcast(of_class.where("hot").drop("hot"))
    named = rows.join(few, "fp").unionByName(
        rows.join(few, "fp", "left_anti").join(of_class.where("not hot").drop("hot"), "fp", "left")
    )
    return named.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"),
    )
