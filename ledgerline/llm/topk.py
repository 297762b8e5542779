"""Exact top-k by inner product, with M-trees and best-first search.

Vectors become points in one more dimension, all at one distance from the origin, so that the nearest points of a
query are those with the largest inner product. A bounded sample gives the routing objects at the top; every vector goes
to a tree of its nearest one, so that a tree holds a region, and one that too many vectors are nearest to has several
trees. A tree is an M-tree: paged nodes with a routing object, its distance from the parent's, a covering radius and
children or entries.

A query first searches a tree near it. What it finds there bounds the distance of all that still matters, so it is sent
on only to trees whose covering radius reaches into that. Within a tree, nodes are taken from a queue in the order of
the nearest point they can hold for a block of queries; what the triangle inequality rules out, by the stored distance of a child
from its parent, by a node's radius or by an entry's distance from its routing object, is never computed.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, batch_rows, written

SCALE = 64
#: Vectors in a tree, entries in a page, children of a node, queries in a block.
TREE, PAGE, FAN, BLOCK = 8192, 256, 8, 512
#: Pairs of a tree and a block, about 5 MB each, that a Python worker holds at once.
PAIRS = 4
#: A tree is one row of some MB: each has pages of its own, a few make a row group, so that readers hold few at once.
LONG_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 16 << 20}
#: Components are cut to this size.
LARGEST = 2.0**62
#: Rows that the routing objects are chosen from, and routing objects at most.
SAMPLE, ROUTES = 2048, 256


def whole_vectors(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(key, v)``: floor(scale * x) of every component, a row per key.

    Vectors that are null or hold null or non-finite components are left out, as are null keys; a repeated key
    counts once, with its smallest vector.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    cut = lambda x: F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    v = F.transform(vector, lambda x: F.floor(cut(x)).cast("long"))
    return rows.select(F.col(key).cast("long").alias("key"), v.alias("v")).groupBy("key").agg(F.min("v").alias("v"))


def _matrix(lists: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(lists), size))
    for i, v in enumerate(lists.to_pylist()):
        out[i, : len(v)] = v
    return out


def _routes(sample: np.ndarray, most: int) -> np.ndarray:
    """Points of the sample far from each other: each next one is the farthest from those before."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares, 0))


def _lifted(x: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with one more component that makes all norms ``reach``: the nearest one has the highest inner product."""
    return np.hstack([x, np.sqrt(np.maximum(reach - (x * x).sum(1), 0))[:, None]])


def _far(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of queries, whose last component is 0, from lifted points."""
    return _distances((q * q).sum(1)[:, None] + (points * points).sum(1) - 2 * (q @ points[:, :-1].T))


class Tree:
    """An M-tree of lifted vectors. A node has a routing object, the distance of that from its parent's, a covering
    radius, and either child nodes or a page of entries, sorted by their distance from the routing object."""

    FIELDS = {"keys": "<i8", "entries": "<i8", "gaps": "<f8", "pivots": "<f8", "radius": "<f8", "apart": "<f8", "first": "<i4", "last": "<i4", "leaf": "?"}

    def __init__(self, size: int, **arrays: np.ndarray) -> None:
        self.size = size
        for name, kind in self.FIELDS.items():
            value = arrays[name]
            setattr(self, name, np.frombuffer(value, kind) if isinstance(value, bytes) else value)
        self.entries = self.entries.reshape(len(self.keys), size).astype(np.float64)
        self.pivots = self.pivots.reshape(len(self.radius), size + 1)

    @classmethod
    def build(cls, keys: np.ndarray, x: np.ndarray, reach: float, root: np.ndarray) -> Tree:
        """The tree of these vectors below a routing object of their own."""
        points = _lifted(x, reach)
        order, gaps = np.arange(len(x)), np.empty(len(x))
        nodes: list[dict] = [{"pivot": root, "apart": 0.0, "rows": order}]
        out: list[np.ndarray] = []
        at, done = 0, 0
        while at < len(nodes):  # children of a node stand in a row, entries of a page too
            node = nodes[at]
            rows, pivot = node["rows"], node["pivot"]
            far = _distances(((points[rows] - pivot) ** 2).sum(1))
            node["radius"] = float(far.max(initial=0.0))
            parts = cls._parts(points, rows) if len(rows) > PAGE else None
            if parts is None:
                turn = np.lexsort((keys[rows], far))
                out.append(rows[turn])
                gaps[done : done + len(rows)] = far[turn]
                node.update(leaf=True, first=done, last=done + len(rows))
                done += len(rows)
            else:
                node.update(leaf=False, first=len(nodes), last=len(nodes) + len(parts))
                nodes += [{"pivot": p, "apart": float(np.sqrt(((p - pivot) ** 2).sum())), "rows": r} for p, r in parts]
            node["rows"] = None
            at += 1
        order = np.concatenate(out)
        column = lambda name, kind: np.array([n[name] for n in nodes], kind)
        return cls(
            x.shape[1], keys=keys[order], entries=x[order], gaps=gaps, pivots=np.array([n["pivot"] for n in nodes]).ravel(),
            radius=column("radius", float), apart=column("apart", float), first=column("first", np.int32),
            last=column("last", np.int32), leaf=column("leaf", bool),
        )

    @staticmethod
    def _parts(points: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Up to ``FAN`` routing objects far from each other, chosen among some of the rows, and the rows nearest to each."""
        some = points[rows[:: max(1, len(rows) // 256)]]
        chosen = _routes(some, FAN)
        near = ((points[rows] ** 2).sum(1)[:, None] + (chosen**2).sum(1) - 2 * points[rows] @ chosen.T).argmin(1)
        parts = [(chosen[c], rows[near == c]) for c in range(len(chosen)) if (near == c).any()]
        if max(len(r) for _, r in parts) <= 0.9 * len(rows):
            return parts
        # equal vectors, or few that stand apart: as many parts of one size, by the distance from the first
        turn = rows[np.argsort(((points[rows] - chosen[0]) ** 2).sum(1), kind="stable")]
        cuts = np.array_split(turn, max(2, min(FAN, len(rows) // PAGE)))
        return [(points[r[len(r) // 2]], r) for r in cuts]

    def blobs(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS.items()}

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, reach: float, k: int, counted: list | None = None):
        """The k best entries for each query: scores and keys, best first; -inf scores none.

        ``least``: a score that entries must reach to matter. Nodes come from a queue, those that may be nearest to some
        query first. Children are first judged by what is stored: the parent's distance from the query and from the child.
        """
        square = (q * q).sum(1)
        slack = 1e-6 * (1 + math.sqrt(reach) + _distances(square))
        best = np.full((len(q), k), -np.inf)
        names = np.full((len(q), k), np.iinfo(np.int64).max)
        count = [0] if counted is None else counted

        def limit() -> np.ndarray:
            score = np.maximum(best.min(1), least)
            return np.where(np.isinf(score), np.inf, _distances(square + reach - 2 * np.where(np.isinf(score), 0, score))) + slack

        here = limit()
        far = _far(q, self.pivots[:1])[:, 0]
        count[0] += len(q)
        queue = [(float(np.maximum(far - self.radius[0], 0).min()), 0, far)]
        while queue:
            _, node, far = heapq.heappop(queue)
            asking = np.flatnonzero(np.isfinite(far) & (far - self.radius[node] <= here))
            if not len(asking):
                continue
            first, last = self.first[node], self.last[node]
            if not self.leaf[node]:
                children = np.arange(first, last)
                may = np.abs(far[asking, None] - self.apart[children]) - self.radius[children] <= here[asking, None]
                for child in children[may.any(0)]:
                    who = asking[may[:, child - first]]
                    seen = np.full(len(q), np.inf)
                    seen[who] = _far(q[who], self.pivots[child : child + 1])[:, 0]
                    count[0] += len(who)
                    bound = seen[who] - self.radius[child]
                    if (bound <= here[who]).any():
                        heapq.heappush(queue, (float(max(bound.min(), 0.0)), int(child), seen))
                continue
            near, reached = far[asking], here[asking]
            a = first + np.searchsorted(self.gaps[first:last], (near - reached).min(), "left")
            b = first + np.searchsorted(self.gaps[first:last], (near + reached).max(), "right")
            if a == b:
                continue
            count[0] += len(asking) * int(b - a)
            score = q[asking] @ self.entries[a:b].T
            ids = np.broadcast_to(self.keys[a:b], score.shape)
            score = np.where(ids == own[asking][:, None], -np.inf, score)
            merged, named = np.hstack([best[asking], score]), np.hstack([names[asking], ids])
            part = np.argpartition(-merged, k - 1, axis=1)[:, :k]
            found, known = np.take_along_axis(merged, part, 1), np.take_along_axis(named, part, 1)
            cut = found.min(1)
            # of several with the k-th score the smaller keys stay
            for row in np.flatnonzero(np.isfinite(cut) & ((merged >= cut[:, None]).sum(1) > k)):
                at = np.flatnonzero(merged[row] >= cut[row])
                at = at[np.lexsort((named[row, at], -merged[row, at]))[:k]]
                found[row], known[row] = merged[row, at], named[row, at]
            best[asking], names[asking] = found, known
            here = limit()
        order = np.lexsort((names, -best))
        return np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)


def _built(rows: DataFrame, routes: np.ndarray, reach: float, size: int) -> DataFrame:
    """A row per tree of ``rows(tree, route, key, v)``."""

    def build(table):
        route = table["route"][0].as_py()
        made = Tree.build(table["key"].to_numpy(), _matrix(table["v"], size), reach, routes[route])
        return pa.table({"tree": table["tree"].slice(0, 1), "route": table["route"].slice(0, 1), "covers": [made.radius[0]],
                         **{name: pa.array([blob], pa.binary()) for name, blob in made.blobs().items()}})

    schema = "tree long, route int, covers double, " + ", ".join(f"{name} binary" for name in Tree.FIELDS)
    return rows.groupBy("tree").applyInArrow(build, schema)


def _searched(asked: DataFrame, trees: DataFrame, n_blocks: int, size: int, reach: float, k: int) -> DataFrame:
    """``(query_id, key, score)``: what each tree has for the queries ``asked(tree, key, v, least)``, in blocks."""
    blocks = asked.groupBy("tree", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("key", "v", "least")).alias("asked")
    )

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for row in range(batch.num_rows):
            block = batch.column("asked")[row].values
            ids, q = block.field("key").to_numpy(), _matrix(block.field("v"), size)
            least = block.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
            tree = Tree(size, **{name: batch.column(name)[row].as_py() for name in Tree.FIELDS})
            best, names = tree.search(q, ids, np.where(np.isnan(least), -np.inf, least), reach, k)
            at, place = np.nonzero(~np.isinf(best))
            out[0].append(ids[at])
            out[1].append(names[at, place])
            out[2].append(np.clip(best[at, place], -LARGEST, LARGEST).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "key", "score"])

    pairs = blocks.join(trees.hint("merge"), "tree").select("asked", *Tree.FIELDS)
    found = arrow_map(pairs, search, "query_id long, key long, score long")
    with batch_rows(asked.sparkSession, PAIRS):
        return written(found, "found")


def top_k(
    queries: DataFrame, table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = SCALE
) -> DataFrame:
    """``(query_id, rank, <key>, score)``: for each query the k rows of the table with the highest inner products.

    Ties go to the smaller key; a row with the query's own key is no candidate. Fewer candidates give fewer rows.
    Null vectors, vectors with null or non-finite components and null keys take no part; shorter vectors count
    as if they ended in zeros; a repeated key counts once, with its smallest vector. Scores are exact while
    they stay below 2^53; beyond, ranks and scores are those of double arithmetic. Components are cut to 2^62. Other columns are not read. An empty table gives an empty result.
    """
    rows = written(whole_vectors(table, key, vector, scale), "vectors")
    asked = written(whole_vectors(queries, key, vector, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, size, reach = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    size = max(size or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    if not n:
        return asked.selectExpr("key as query_id", "0 as rank", f"key as `{key}`", "0L as score").limit(0)
    reach = float(reach)
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()
    routes = _routes(_lifted(_matrix(sample["v"], size), reach), min(ROUTES, -(-n // TREE)))

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        far = (routes**2).sum(1) - 2 * (_lifted(_matrix(batch.column("v"), size), reach) @ routes.T)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(1).astype(np.int32))], names=["key", "v", "route"])

    # Vectors go to the tree of their nearest routing object; where these are too many for one, to one of several.
    near = written(arrow_map(rows, nearest, "key long, v array<bigint>, route int"), "near")
    counts = dict(near.groupBy("route").count().collect())  # a number for each routing object
    pieces = [-(-counts.get(r, 0) // TREE) for r in range(len(routes))]
    starts = np.cumsum([0, *pieces])
    part = lambda c, values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col(c))
    tree = (part("route", starts[:-1]) + F.pmod(F.xxhash64("key"), F.greatest(part("route", pieces), F.lit(1)))).cast("long")
    trees = written(_built(near.withColumn("tree", tree), routes, reach, size), "trees", **LONG_ROWS)
    radius = np.full(len(routes), -np.inf)
    for r in trees.groupBy("route").agg(F.max("covers").alias("covers")).collect():
        radius[r.route] = r.covers
    n_blocks = max(1, -(-asked.count() // BLOCK))

    # First a tree near the query: its k-th best score is what other trees must beat.
    used = np.flatnonzero(np.isfinite(radius))

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        far = _far(_matrix(batch.column("v"), size), routes[used])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(used[far.argmin(1)].astype(np.int32))], names=["key", "v", "route"])

    homes = arrow_map(asked, home, "key long, v array<bigint>, route int").withColumn("tree", tree)
    homes = written(homes.withColumn("least", F.lit(None).cast("long")), "homes")
    first = _searched(homes, trees, n_blocks, size, reach, k)
    enough = first.groupBy(F.col("query_id").alias("key")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The routing objects whose trees may hold a vector that is good enough, by their covering radii."""
        q, least = _matrix(batch.column("v"), size), batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        square = (q * q).sum(1)
        reached = np.where(np.isnan(least), np.inf, _distances(square + reach - 2 * np.nan_to_num(least)))
        reached = reached + 1e-6 * (1 + math.sqrt(reach) + _distances(square))
        may = [np.flatnonzero(row).astype(np.int32) for row in (_far(q, routes) - radius <= reached[:, None]) & np.isfinite(radius)]
        ends = np.cumsum([0, *map(len, may)], dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(may)))], names=["key", "v", "home", "least", "routes"]
        )

    known = homes.drop("least", "route").withColumnRenamed("tree", "home").join(enough.hint("merge"), "key", "left")
    known = arrow_map(known.select("key", "v", "home", "least"), others, "key long, v array<bigint>, home long, least long, routes array<int>")
    route = known.select("key", "v", "home", "least", F.explode("routes").alias("route"))
    span = F.sequence(part("route", starts[:-1]).cast("long"), part("route", starts[1:]).cast("long") - 1)
    more = route.select("key", "v", "home", "least", F.explode(span).alias("tree")).where("tree <> home")
    found = first.unionByName(_searched(more, trees, n_blocks, size, reach, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("key").alias(key), "score")
