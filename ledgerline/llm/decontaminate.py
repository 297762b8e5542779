"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark text. Words are numbers, patterns are places in one array of
them, and all tables are arrays, so that megabytes of benchmark take few times their size. The search reads a document at
positions ``length`` words apart unless the shift table, keyed by blocks of two words, tells it to go slower; where the
shift is nil, the bucket of the block and of the first two words names the patterns, and a comparison of all
their words confirms them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BATCH_ROWS, LOWER, arrow_map, written
from ledgerline.session import scratch_path

WINDOW = 10
#: Benchmark bytes whose tables go to the executors at once; larger sets are searched for in several passes, and a
#: text above ``CUT_BYTES`` is cut, with as much overlap as a window needs.
PASS_BYTES, CUT_BYTES = 8 << 20, 1 << 20
#: Bytes that stand in no word: ASCII but letters and digits.
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_WORDS = bytes(b if b in _KEEP else 32 for b in LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class _Length:
    """Tables of the patterns of one length, as sorted arrays. ``words`` are the numbers of all benchmark words in a row,
    ``starts`` the places where patterns begin and ``items`` the text that each is from."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, items: np.ndarray, base: int) -> None:
        self.length, self.block, self.words, self.base = length, min(2, length), words, base
        # equal patterns once: the order of all by their words, a word at a time from the last
        order = np.lexsort([words[starts + k] for k in range(length - 1, -1, -1)])
        starts, items = starts[order], items[order]
        new = np.ones(len(starts), bool)
        if len(starts) > 1:
            new[1:] = np.any([words[starts[1:] + k] != words[starts[:-1] + k] for k in range(length)], axis=0)
        self.first_item = np.r_[np.flatnonzero(new), len(items)].astype(np.int64)
        self.items, starts = items, starts[new]
        suffix, prefix = self.codes(starts + length - self.block), self.codes(starts)
        order = np.lexsort((prefix, suffix))
        self.starts, self.suffix, self.prefix, self.nth = starts[order], suffix[order], prefix[order], order
        # the least step of each block: those nearest to the end of a pattern first
        self.keys, self.steps = np.empty(0, np.int64), np.empty(0, np.int8 if length < 128 else np.int32)
        for end in range(length, self.block - 1, -1):
            new = np.setdiff1d(self.codes(starts + end - self.block), self.keys)
            if len(new):
                place = np.searchsorted(self.keys, new)
                self.keys = np.insert(self.keys, place, new)
                self.steps = np.insert(self.steps, place, length - end)

    def codes(self, at: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """The blocks that begin at the places, as numbers."""
        words = self.words if words is None else words
        return words[at].astype(np.int64) * self.base + (words[at + 1] if self.block == 2 else 0)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(first, last, texts)`` of the patterns in a document, given as numbers, 0 for words of no pattern."""
        length, block, n = self.length, self.block, len(ids)
        if n < length or not len(self.keys):
            return
        codes = self.codes(np.arange(n - block + 1), ids)
        place = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        shift = np.where(self.keys[place] == codes, self.steps[place], np.int32(length - block + 1)).tolist()
        at = length
        while at <= n:
            step = shift[at - block]
            if step:
                at += step
                continue
            first, low = at - length, np.searchsorted(self.suffix, codes[at - block])
            high = np.searchsorted(self.suffix, codes[at - block], "right")
            low, high = (low + np.searchsorted(self.prefix[low:high], codes[first], side) for side in ("left", "right"))
            for k in range(low, high):
                start = self.starts[k]
                if np.array_equal(self.words[start : start + length], ids[first:at]):
                    nth = self.nth[k]
                    yield first, at, self.items[self.first_item[nth] : self.first_item[nth + 1]]
            at += 1


class Patterns:
    """All windows of the given texts, with the ids of the texts that hold them."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        parts, starts, at = [], defaultdict(list), 0
        for n, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            if size:
                parts.append(np.array(ids, np.int32))
                places = np.arange(at, at + len(ids) - size + 1, dtype=np.int64)
                starts[size].append((places, np.full(len(places), n, np.int32)))
                at += len(ids)
        words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.lengths = [
            _Length(size, words, np.concatenate([p for p, _ in found]), np.concatenate([i for _, i in found]), len(self.numbers) + 1)
            for size, found in starts.items()
        ]

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word ranges that lie inside occurrences, and the items that occur."""
        found, items = [], set()
        known = self.numbers.get
        ids = np.fromiter((known(w, 0) for w in words), np.int32, len(words))
        for table in self.lengths:
            for first, end, texts in table.find(ids):
                found.append((first, end))
                items.update(self.items[n] for n in texts.tolist())
        merged: list[tuple[int, int]] = []
        for first, end in sorted(found):
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((first, end))
        return merged, items


def _cut(window: int):
    """Long texts in pieces that hold all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or len(text) <= CUT_BYTES // 4:
                    items.append(item)
                    texts.append(text)
                    continue
                words = words_of(text)
                step = max(1, CUT_BYTES // 4 * len(words) // len(text))
                for start in range(0, max(1, len(words) - window + 1), step):
                    items.append(item)
                    texts.append(b" ".join(words[start : start + step + window - 1]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return run


def _passes(benchmark: DataFrame, item: str, text: str, window: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many pieces of bounded size the benchmark makes, and the pieces, of which one at a time is on the driver.

    One piece is the usual case; otherwise the texts are written by piece, so that none is read twice.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if n_bytes <= PASS_BYTES:
        return 1, iter([[tuple(r) for r in rows.collect()]])
    pieces = 2 * -(-n_bytes // PASS_BYTES)
    spark, path = benchmark.sparkSession, scratch_path(benchmark.sparkSession, "benchmark")
    dealt = rows.mapInArrow(_cut(window), "item string, text string")
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("item", "text"), F.lit(pieces)).cast("int"))
    dealt.write.partitionBy("piece").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    return pieces, ([tuple(r) for r in dealt.where(F.col("piece") == p).select("item", "text").collect()] for p in range(pieces))


_SPANS = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def find_passages(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """A row per document: its key, ``n_words``, ``spans`` (merged ranges of hit words) and ``items``.

    Null and empty texts have no words and no spans. A benchmark text of fewer words than the window is one
    pattern; without words it is none. Null item ids hit but are not listed. Repeated rows are judged each.
    Texts of any length are searched whole. Other columns are not read, so their names cannot clash. An empty benchmark
    hits nothing. A benchmark above ``PASS_BYTES`` is searched for in several passes, whose spans are then merged by text.
    """
    count, passes = _passes(benchmark, item, item_text, window)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def search(items: list[tuple]):
        tables = docs.sparkSession.sparkContext.broadcast(items)
        state: dict = {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            patterns = state.get("p") or state.setdefault("p", Patterns(tables.value, window))
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            found = [patterns.spans(w) for w in words]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in s] for s, _ in found],
                             pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array([sorted(i for i in ids if i is not None) for _, ids in found], pa.list_(pa.string())),
                ],
                names=["key" if count == 1 else "text", "n_words", "spans", "items"],
            )

        return run

    if count == 1:
        return arrow_map(rows, search(next(passes)), f"key {kind}, {_SPANS}").withColumnRenamed("key", key)
    texts = written(rows.where("text is not null").select("text").distinct(), "texts")
    # each pass is over before the next piece comes to the driver; texts without a hit need no row but the first pass's
    parts = [written(arrow_map(texts, search(p), f"text string, {_SPANS}").where("size(spans) > 0" if n else "true"), "found")
             for n, p in enumerate(passes)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = written(
        union.groupBy("text").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ),
        "passages",
    )
    joined = rows.join(merged, "text", "left")
    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return joined.select(
        F.col("key").alias(key), F.coalesce("n_words", F.lit(0)).alias("n_words"),
        _merged_spans(F.coalesce("spans", none)).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def _merged_spans(spans):
    """Sorted spans with those that touch or overlap joined."""
    kind = "array<struct<first:int,last:int>>"

    def step(done, span):
        last = F.get(done, F.size(done) - 1)  # null while nothing is done
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        return F.when(
            (F.size(done) > 0) & (span["first"] <= last["last"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.expr(f"cast(array() as {kind})"), step)


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The documents without a hit word, with all their columns; none is added, so no name can clash.

    Null and empty texts are clean.
    """
    count, passes = _passes(benchmark, item, item_text, window)
    for n, items in enumerate(passes):
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(items), text, window)
        if n + 1 < count:
            docs = written(docs, "clean")
    return docs


def _without(docs: DataFrame, tables, text: str, window: int) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(tables.value, window)
        for batch in batches:
            clean = [not patterns.spans(words_of(t))[0] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def hits(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans and items of ``find_passages`` as counts and a digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
