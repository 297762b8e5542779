"""How the sources of a language differ: exact divergences of their term distributions, by K-squared quadtrees.

1. Each task counts the terms of its documents per language and source before anything is shuffled. One shuffle by
   (language, term) adds the counts up and drops the terms of too few documents.
2. The matrix of a language has a row per source and a column per kept term. Its columns are dealt into strips and its
   rows into blocks, so that a tile (two blocks of rows, one strip) has a bounded number of cells.
3. A tile's cells become a quadtree: each node has four quadrants, all-zero ones are cut off. The tree is walked for two
   ranges of rows at once. Where both are all zero, nothing is computed: the two sources have the same two values in
   every such column, so all of them together are one multiplication when the tiles are added up. Where one is nonzero,
   the walk goes on to the leaves, which are priced cell by cell.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written

#: Parts in a distribution: p = 1 + floor(UNIT * (count + 1) / (N + V)).
UNIT = 1_000_000_000
#: Counts that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Cells of a tile, dense; rows of a block of sources; the side of a leaf in rows and in columns.
TILE_CELLS = 1 << 20
BLOCK_ROWS = 512
LEAF = 8, 256

#: A-Z lower-cased, other letters kept, everything else ASCII to a space.
_TERMS = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def _counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, source, term, n, docs)``, several rows for a term that several tasks met."""
    one = 1 << 44  # documents above it, occurrences below

    def packed(held) -> pa.RecordBatch:
        langs, sources, terms, counts = [], [], [], []
        for (l, s), found in held.items():
            langs += [l] * len(found)
            sources += [s] * len(found)
            terms += found.keys()
            counts += found.values()
        both = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(both & (one - 1)), pa.array(both >> 44)], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(dict), 0
        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for value, l, s in zip(batch.column(0), langs, sources):
                found = held[l, s]
                size -= len(found)
                seen: dict[bytes, int] = {}
                for term in terms_of(value.as_py()):
                    seen[term] = seen.get(term, one) + 1
                for term, n in seen.items():
                    found[term] = found.get(term, 0) + n
                size += len(found)
                if size >= HELD_TERMS:
                    yield packed(held)
                    held, size = defaultdict(dict), 0
        yield packed(held)

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    plain = plain.select(F.col("text").cast("binary").alias("text"), "lang", "source")
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + terms))`` in whole numbers; null where there are no terms."""
    size = f"({total} + {terms})"
    return F.expr(f"if({terms} = 0, null, 1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({size} as decimal(19,0)))")


class QuadTree:
    """All-zero quadrants of a matrix cut off, down to leaves of ``LEAF`` cells; the cells are kept in the leaves.

    Level 0 is one node; each node of a level has four children in the next, present only if nonzero. The side is a
    power of two in leaves; a matrix that is not square is padded with all-zero leaves, which cost nothing.
    """

    def __init__(self, rows: int, columns: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.high, self.wide = LEAF
        across = max(-(-rows // self.high), -(-columns // self.wide), 1)
        self.depth = (across - 1).bit_length()
        side, r, c = 1 << self.depth, row // self.high, column // self.wide
        present = np.zeros((side, side), bool)
        present[r, c] = True
        self.levels = [present]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            self.levels.insert(0, below[::2, ::2] | below[1::2, ::2] | below[::2, 1::2] | below[1::2, 1::2])
        order = np.lexsort((c, r))
        place = (r * side + c)[order]
        ids, starts = np.unique(place, return_index=True)
        ends = np.r_[starts[1:], len(place)]
        self.leaves = {(int(p) // side, int(p) % side): order[a:b] for p, a, b in zip(ids, starts, ends)}
        self.row, self.column, self.value = row, column, value

    def nonzero(self, level: int, r: int, c: int) -> bool:
        return bool(self.levels[level][r, c])

    def leaf(self, r: int, c: int, floor: np.ndarray, columns: int) -> np.ndarray:
        """The leaf's cells; ``floor`` is what a zero cell of each row counts as."""
        top, left = r * self.high, c * self.wide
        cells = np.repeat(floor[top:top + self.high, None], min(self.wide, columns - left), axis=1)
        at = self.leaves.get((r, c))
        if at is not None:
            cells[self.row[at] - top, self.column[at] - left] = self.value[at]
        return cells


def joint_sums(tree: QuadTree, floor: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """``(value, seen)`` for all pairs of rows: the sum of ``floor((p - q)^2 / q)`` over the columns that were
    priced, p the first row's and q the second's, and how many these are."""
    rows = len(floor)
    value, seen = np.zeros((rows, rows), np.int64), np.zeros((rows, rows), np.int64)
    pending = [(0, 0, 0, 0)]
    while pending:
        level, a, b, c = pending.pop()  # two row quadrants over one range of columns, a <= b
        if not (tree.nonzero(level, a, c) or tree.nonzero(level, b, c)):
            continue
        if level < tree.depth:
            below = [(2 * a + i, 2 * b + j) for i in (0, 1) for j in (0, 1) if 2 * a + i <= 2 * b + j]
            span = tree.high << (tree.depth - level - 1)
            pending += [
                (level + 1, x, y, 2 * c + k) for x, y in below if x * span < rows and y * span < rows for k in (0, 1)
            ]
            continue
        p, q = (tree.leaf(r, c, floor, columns) for r in (a, b))
        square = (p[:, None, :] - q[None, :, :]) ** 2
        ra, rb = (slice(r * tree.high, r * tree.high + tree.high) for r in (a, b))
        value[ra, rb] += (square // q[None, :, :]).sum(axis=2)
        seen[ra, rb] += p.shape[1]
        if a != b:
            value[rb, ra] += (square // p[:, None, :]).sum(axis=2).T
            seen[rb, ra] += p.shape[1]
    return value, seen


def _tile(key, cells):
    """Sums of one tile. Rows without a term name the sources of the tile's blocks and their zero value."""
    named = cells.filter(pc.is_null(cells["term"]))
    ids, first = np.unique(named["row"].to_numpy(), return_index=True)
    floor = named["p"].to_numpy()[first]
    cells = cells.filter(pc.is_valid(cells["term"]))
    lang, _, one, other = key
    empty = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())])
    if not cells.num_rows:
        return empty.empty_table()
    codes = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    row = np.searchsorted(ids, cells["row"].to_numpy())
    columns = int(codes.max()) + 1
    # columns with the same first source stand together, so that quadrants are all zero or well filled
    least = np.full(columns, len(ids))
    np.minimum.at(least, codes, row)
    place = np.empty(columns, np.int64)
    place[np.lexsort((np.bincount(codes, minlength=columns), least))] = np.arange(columns)
    value, seen = joint_sums(QuadTree(len(ids), columns, row, place[codes], cells["p"].to_numpy()), floor, columns)
    wanted = seen > 0
    np.fill_diagonal(wanted, False)
    if one.as_py() != other.as_py():  # pairs inside a block belong to the tile of that block alone
        block = ids // BLOCK_ROWS
        wanted &= block[:, None] != block[None, :]
    a, b = np.nonzero(wanted)
    return pa.table(
        [pa.array([lang.as_py()] * len(a), pa.string()), pa.array(ids[a]), pa.array(ids[b]), pa.array(value[a, b]), pa.array(seen[a, b])],
        schema=empty,
    )


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for all ordered pairs of sources of a language."""
    strips = "cast(ceil(v * least(g, 2 * {0}) / {1}) as int)".format(BLOCK_ROWS, TILE_CELLS)
    blocks = f"cast(ceil(g / {BLOCK_ROWS}) as int)"
    # a block of rows meets itself and every other block
    tiles = f"transform(sequence(0, {blocks} - 1), o -> struct(least(block, o) as one, greatest(block, o) as other))"
    block = F.expr(f"cast(row div {BLOCK_ROWS} as int)")
    rows = cells.withColumn("block", block).withColumn("strip", F.expr(f"pmod(xxhash64(term), {strips})"))
    rows = rows.select("lang", "strip", "row", "p", "term", F.inline(F.expr(tiles)))
    zero = groups.where("v > 0").withColumn("block", block).select("*", F.explode(F.expr(f"sequence(0, {strips} - 1)")).alias("strip"))
    zero = zero.select("lang", F.col("strip").cast("long").alias("strip"), "row", F.col("p0").alias("p"), F.lit(None).cast("string").alias("term"), F.inline(F.expr(tiles)))
    parts = rows.unionByName(zero).groupBy("lang", "strip", "one", "other").applyInArrow(
        _tile, "lang string, a long, b long, value long, seen long"
    )
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("part"), F.sum("seen").alias("seen"))
    side = lambda row, name: groups.select("lang", F.col("row").alias(row), F.col("source").alias(name), F.col("p0").alias(f"p_{row}"))
    both = side("a", "source").join(side("b", "item"), "lang").where("a <> b")
    sized = both.join(groups.select("lang", "v").distinct(), "lang").join(sums, ["lang", "a", "b"], "left")
    uniform = "(p_a - p_b) * (p_a - p_b) div p_b"
    value = F.expr(f"if(v = 0, 0L, coalesce(part, 0L) + (v - coalesce(seen, 0L)) * ({uniform}))")
    return sized.select("lang", "source", "item", value.alias("value"))


def divergence(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, most_terms: int = 200
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source of a language differs from the others and in what.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps those in at least
    ``least_docs`` of its documents. A group (language and source), and the language as a whole, gives each of the V kept
    terms ``p = 1 + floor(10^9 (count + 1) / (N + V))``. Part ``pair``: every other source, with the sum over all kept
    terms of ``floor((p - q)^2 / q)``, q the other's; all ranks. Part ``term``: the kept terms of the group that it uses
    more than its language (p > q), with their share of that sum; ranks up to ``most_terms``. Ranks start at 1, by
    falling value, then by the bytes of the item.

    Null texts, languages and sources count as empty; an empty language or source is one like any other. Groups without
    terms take part, with count 0 everywhere; in a language without kept terms every pair has value 0. Repeated rows
    count as often as given. Long texts are read whole. Other columns are not read. An empty table gives an empty result.
    """
    counted = _counted(docs, text, lang, source)
    both = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # at most as many entries in a list as the language has sources
    columns = both.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("cells")
    )
    columns = written(columns.where(F.col("docs") >= least_docs).drop("docs"), "columns")
    cells = columns.select("lang", "term", "n_lang", F.inline("cells"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    sizes = columns.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_total"))
    here = Window.partitionBy("lang")
    groups = names.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n_all", "v", "n_total"])
    groups = groups.withColumns({
        "row": F.row_number().over(here.orderBy("source")).cast("long") - 1, "g": F.count(F.lit(1)).over(here),
    })
    groups = written(groups.withColumn("p0", probability("0", "n_all", "v")), "groups")
    placed = cells.join(groups, ["lang", "source"])
    placed = placed.withColumns({"p": probability("n", "n_all", "v"), "q": probability("n_lang", "n_total", "v")})
    own = placed.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = own.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    pairs = _pairs(placed, groups).withColumns({"rank": F.row_number().over(by), "part": F.lit("pair")})
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*order).unionByName(terms.select(*order))
