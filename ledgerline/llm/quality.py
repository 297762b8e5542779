"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Counts of character n-grams are summed over the trusted documents; the counts of lower orders are numbers of
distinct left neighbours. Documents are dealt into blocks of bounded size, each block asks for every n-gram that it
holds once, the distinct n-grams of all blocks are joined to the counts of their orders and contexts, and the
probabilities go back to the blocks, which add them up per document. Neither counts nor probabilities are ever
gathered in one place. A document is rejected if its log-perplexity is further above the median of the trusted
documents of its language than these themselves vary at its length.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, written

ORDER = 4
#: A document is rejected if its log-perplexity lies above the median of its language's trusted documents by more than
#: ``MARGIN`` times this quantile of their own distances from it, each distance taken in units of 1/sqrt(characters).
#: ``MARGIN`` allows for trusted documents being in the counts; it was chosen on trusted rows kept out of them.
QUANTILE, MARGIN = 0.99, 2.0
#: A language with fewer differing trusted texts takes the limit over all languages if that is higher than its own.
LEAST_TRUSTED = 30
#: Quantiles are taken of values in steps of 1/``STEPS``: counts per step add up alike however the rows are dealt.
STEPS, WIDE = 10_000, 200
#: N-grams of orders 1 and 2 that are sent to all executors, about 30 MB; above, they are joined by shuffle.
BROADCAST_GRAMS = 500_000
#: Characters of text in a block.
BLOCK_CHARS = 8 << 20
#: Trusted or rejected keys that are sent to all executors; above, the documents are shuffled.
BROADCAST_IDS = 200_000


def _plain(text: str | None) -> str:
    """White space runs as one space; no null characters."""
    return " ".join(text.replace("\0", " ").split()) if text else ""


def _unpacked(texts: list[bytes]) -> list[str]:
    squeeze = zstandard.ZstdDecompressor()
    return [squeeze.decompress(t).decode("utf-8", "surrogatepass") for t in texts]


def _renumbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the place of each code among them."""
    if len(codes) and int(codes.max()) < max(1 << 24, 4 * len(codes)):
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int64) - 1)[codes]
    return np.unique(codes, return_inverse=True)


def _first_places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order and where each first stands."""
    first = np.full(int(place.max()) + 1, -1, np.int64)
    first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
    kinds = np.flatnonzero(first >= 0)
    return kinds, first[kinds]


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as strings, the number of the n-gram at each place, and the text of each place."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    if len(flat) < order:
        return np.empty(0, f"<U{order}"), np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[order - 1 :] == owner[: len(flat) - order + 1]
    letters, ids = _renumbered(flat.astype(np.int64))
    place = ids
    for step in range(1, order):  # number the n-grams by number of the one without its last letter, and that letter
        _, place = _renumbered(place[:-1] * len(letters) + ids[step:])
    # places that reach over the end of a text are no n-grams
    place = place[whole]
    kinds, first = np.unique(place, return_index=True) if len(place) < 1 << 12 else _first_places(place)
    number = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, np.int64)
    number[kinds] = np.arange(len(kinds))
    place = number[place]
    at = np.flatnonzero(whole)[first]
    chars = np.lib.stride_tricks.sliding_window_view(flat, order)[at]
    return np.ascontiguousarray(chars).view(f"<U{order}").ravel(), place, owner[: len(whole)][whole]


def trusted_keys(labels: DataFrame, *, key: str = "doc_id", quality: str = "quality", rows: int | None = None) -> DataFrame:
    """Keys labelled 1 and never 0; with ``rows``, so many of them with the smallest hashes."""
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min(quality).alias("q"))
    good = good.where("q = 1").select("__id")
    return good if rows is None else good.orderBy(F.xxhash64("__id"), "__id").limit(rows)


def train(trusted: DataFrame, text: str = "text", order: int = ORDER) -> tuple[DataFrame, dict]:
    """The counts ``(k, key, c, total, n1, n2, n3)`` of n-grams and contexts of all orders k, and the discounts.

    The key is the order, ``g`` for an n-gram or ``c`` for a context, and its characters.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, place, _ = _grams([_plain(t) for t in batch.column(0).to_pylist()], order)
        number = np.bincount(place, minlength=len(grams)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(number)], names=["gram", "c"])

    top = arrow_map(trusted.select(text), count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    level = written(top, "grams")
    every = level.select(F.lit(order).alias("k"), "gram", "c")
    for k in range(order - 1, 0, -1):
        level = level.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        every = every.unionByName(level.select(F.lit(k).alias("k"), "gram", "c"))
    every = written(every, "counts")
    times = [F.count(F.when(F.col("c") == n, 1)).alias(f"t{n}") for n in (1, 2, 3, 4)]
    rows = every.groupBy("k").agg(*times, F.count("*").alias("kinds"), F.sum("c").alias("total")).collect()
    found = {r["k"]: _discounts(r) | {"kinds": r["kinds"], "total": r["total"]} for r in rows}
    sums = [F.sum("c").alias("total"), *(F.count(F.when(w, 1)).alias(n) for n, w in
            (("n1", F.col("c") == 1), ("n2", F.col("c") == 2), ("n3", F.col("c") >= 3)))]
    contexts = every.groupBy("k", F.expr("substring(gram, 1, k - 1)").alias("gram")).agg(*sums)
    none = [F.lit(None).cast("long").alias(n) for n in ("total", "n1", "n2", "n3")]
    table = every.select("k", F.concat("k", F.lit("g"), "gram").alias("key"), "c", *none).unionByName(
        contexts.where("k > 1").select("k", F.concat("k", F.lit("c"), "gram").alias("key"),
                                       F.lit(None).cast("long").alias("c"), "total", "n1", "n2", "n3")
    )
    first = contexts.where("k = 1").first()
    if first:
        found[1] |= {n: first[n] for n in ("n1", "n2", "n3")}
    return table, found


def _discounts(row) -> dict:
    """The three discounts of modified Kneser-Ney, within 0 and the count that they are taken from."""
    t = [row[f"t{n}"] for n in (1, 2, 3, 4)]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
    return {"d": [min(max((n + 1) - (n + 2) * y * t[n + 1] / t[n], 0.1), n + 0.9) if t[n] else (n + 1) / 2 for n in range(3)]}


def probabilities(grams: DataFrame, table: DataFrame, found: dict, order: int = ORDER) -> DataFrame:
    """``(gram, logp)``: the log of the interpolated probability of the last character after the others."""
    key = lambda kind, k: F.concat(F.lit(f"{k}{kind}"), F.substring("gram", order - k + 1, k - (kind == "c")))
    names = {"g": ["c"], "c": ["total", "n1", "n2", "n3"]}
    wanted = [(kind, k) for kind in "gc" for k in range(1 + (kind == "c"), order + 1)]
    # Few keys of the lowest orders stand for all n-grams: a shuffle would gather these by their last letters.
    few = [x for x in wanted if x[1] <= 2] if sum(found[k]["kinds"] for k in (1, 2) if k <= order) <= BROADCAST_GRAMS else []
    rows = grams
    if few:
        low = written(table.where("k <= 2"), "low")
        for kind, k in few:
            part = low.where(F.startswith("key", F.lit(f"{k}{kind}"))).select(
                F.col("key").alias(f"__{kind}{k}"), *[F.col(n).alias(f"{n}_{k}") for n in names[kind]]
            )
            rows = rows.join(F.broadcast(part), key(kind, k) == F.col(f"__{kind}{k}"), "left").drop(f"__{kind}{k}")
    rest = [x for x in wanted if x not in few]
    if rest:
        asked = grams.select("gram", F.posexplode(F.array(*[key(*x) for x in rest])).alias("role", "key"))
        got = asked.join(table, "key")
        parts = [F.max(F.when(F.col("role") == role, F.col(n))).alias(f"{n}_{k}") for role, (kind, k) in enumerate(rest) for n in names[kind]]
        rows = rows.join(got.groupBy("gram").agg(*parts), "gram", "left")
    p = F.lit(1.0 / (found[1]["kinds"] + 1))
    for k in range(1, order + 1):
        d, c = found[k]["d"], F.coalesce(F.col(f"c_{k}"), F.lit(0))
        cut = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        spare = lambda n1, n2, n3, d=d: n1 * d[0] + n2 * d[1] + n3 * d[2]
        if k == 1:
            total = F.lit(float(found[1]["total"]))
            gamma = spare(*(F.lit(found[1][n]) for n in ("n1", "n2", "n3"))) / total
        else:
            total = F.col(f"total_{k}")
            gamma = F.coalesce(spare(*(F.col(f"{n}_{k}") for n in ("n1", "n2", "n3"))) / total, F.lit(1.0))
        own = F.when((c > 0) & total.isNotNull(), F.greatest(c - cut, F.lit(0.0)) / total).otherwise(0.0)
        p = own + gamma * p
    return rows.select("gram", F.log(p).cast("float").alias("logp"))


def perplexities(docs: DataFrame, table: DataFrame, found: dict, *, key: str, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """``(key, lang, mark, n_scored, perplexity)`` per row; null perplexity where no character has a full context."""
    rows = docs.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")
    )
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    kind = dict(rows.dtypes)["key"], dict(rows.dtypes)["lang"]

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1)
        plain = [squeeze.compress(_plain(t).encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "lang", "mark")), pa.array(plain, pa.binary()), batch.column("block")],
            names=["key", "lang", "mark", "text", "block"],
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key", "mark"), F.lit(n)).cast("int"))
    packed = arrow_map(dealt, pack, f"key {kind[0]}, lang {kind[1]}, mark long, text binary, block int")
    blocks = packed.repartition(n, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams of each block; all rows of a block are in one partition."""
        met: dict[int, set] = {}
        for batch in batches:
            texts, block = batch.column("text").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
            for b in np.unique(block):
                grams, _, _ = _grams(_unpacked([texts[i] for i in np.flatnonzero(block == b)]), order)
                met.setdefault(int(b), set()).update(grams.tolist())
        for b, grams in met.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.string()), pa.array(np.full(len(grams), b, np.int32))], names=["gram", "block"]
            )

    # The texts are shuffled once, compressed, by block: both passes below and the scoring read that one shuffle.
    asked = blocks.mapInArrow(ask, "gram string, block int")
    known = probabilities(asked.select("gram").distinct(), table, found, order)
    answers = asked.join(known, "gram").select("block", "gram", "logp")

    def score(texts: pa.Table, logs: pa.Table) -> pa.Table:
        log = dict(zip(logs["gram"].to_pylist(), logs["logp"].to_pylist()))
        sums, counts = np.zeros(texts.num_rows), np.zeros(texts.num_rows, np.int64)
        for start in range(0, texts.num_rows, 256):
            part = _unpacked(texts["text"].slice(start, 256).to_pylist())
            grams, place, owner = _grams(part, order)
            values = np.fromiter((log[g] for g in grams.tolist()), np.float64, len(grams))
            sums[start : start + len(part)] = np.bincount(owner, values[place], len(part))
            counts[start : start + len(part)] = np.bincount(owner, minlength=len(part))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.exp(-sums / counts)
        return pa.table(
            {"key": texts["key"], "lang": texts["lang"], "mark": texts["mark"], "n_scored": pa.array(counts),
             "perplexity": pa.array(value, mask=counts == 0)}
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"key {kind[0]}, lang {kind[1]}, mark long, n_scored long, perplexity double"
    )


def _quantile(rows: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """``by`` and the value that ``share`` of the rows do not exceed, to one step: exact counts per step, added up."""
    steps = rows.groupBy(*by, F.floor(F.col(value) * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    # first among wide steps, then among the few narrow ones of the step that was found
    wide = F.floor(F.col("step") / WIDE)
    ends = steps.groupBy(*by, wide.alias("wide")).agg(F.sum("n").alias("n"))
    order, whole = Window.partitionBy(*by).orderBy("wide"), Window.partitionBy(*by)
    ends = ends.withColumns({"upto": F.sum("n").over(order), "rank": F.ceil(F.sum("n").over(whole) * share)})
    found = ends.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    found = found.select(*[F.col(c).alias(f"__{c}") for c in by], "wide", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], wide == F.col("wide"))
    inside = steps.join(F.broadcast(found), same).withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("step")))
    return inside.where("upto >= left").groupBy(*by).agg(((F.min("step") + 1) / STEPS).alias(out))


def judge(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
    quality: str = "quality", quantile: float = QUANTILE, margin: float = MARGIN,
) -> DataFrame:
    """``(key, lang, mark, n_scored, perplexity, threshold, accepted)`` per row, ``mark`` being the text's hash.

    Null, empty and very short texts have no perplexity and are accepted: there is nothing to judge. The threshold
    depends on the language and on the length: it is higher for short texts, whose perplexity varies more. A language
    without trusted documents takes the threshold over all languages, one with fewer than ``LEAST_TRUSTED`` differing
    trusted texts the higher of that and its own. Without any trusted text everything is accepted. Texts of any length
    are scored whole; a perplexity equal to the threshold is accepted. Repeated rows are judged alike, each of them, and
    count as often among the trusted. Results do not depend on how the rows are dealt. Other columns are not read.
    """
    trusted = written(trusted_keys(labels, key=key, quality=quality), "trusted")
    ids = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    table, found = train(docs.join(ids, F.col(key) == F.col("__id"), "left_semi"), text)
    if not found:
        rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(text).alias("mark"))
        scored = rows.selectExpr("*", "0L as n_scored", "cast(null as double) as perplexity")
    else:
        scored = written(perplexities(docs, table, found, key=key, text=text, lang=lang), "scored")
    good = scored.join(ids, F.col("key") == F.col("__id"), "left_semi").where("perplexity is not null")
    good = good.withColumn("log", F.log("perplexity"))
    middle = _quantile(good, ["lang"], "log", 0.5, "middle").join(
        good.groupBy("lang").agg(F.count_distinct("mark").alias("texts")).withColumnRenamed("lang", "__other"),
        F.col("lang").eqNullSafe(F.col("__other")),
    ).select(F.col("lang").alias("__lang"), "middle", "texts")
    apart = good.join(middle, F.col("lang").eqNullSafe(F.col("__lang"))).withColumn(
        "apart", (F.col("log") - F.col("middle")) * F.sqrt("n_scored")
    )
    apart = written(apart.select("__lang", "middle", "texts", "apart"), "apart")
    own = _quantile(apart, ["__lang", "middle", "texts"], "apart", quantile, "reach").withColumn("reach", F.col("reach") * margin)
    every = F.lit(0).alias("one")
    over = _quantile(apart.select(every, "middle"), ["one"], "middle", quantile, "middle_all").join(
        _quantile(apart.select(every, "apart"), ["one"], "apart", quantile, "reach_all").withColumn("reach_all", F.col("reach_all") * margin), "one"
    ).drop("one")
    rows = scored.join(own, F.col("lang").eqNullSafe(F.col("__lang")), "left").join(F.broadcast(over), how="left")
    size = F.sqrt(F.greatest("n_scored", F.lit(1)))
    one, every = F.col("middle") + F.col("reach") / size, F.col("middle_all") + F.col("reach_all") / size
    threshold = F.exp(F.when(F.col("texts") >= LEAST_TRUSTED, one).otherwise(F.greatest(one, every)))
    return rows.select(
        F.col("key").alias(key), F.col("lang").alias(lang), "mark", "n_scored", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("accepted"),
    )


def accepted_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **more) -> DataFrame:
    """The documents that ``judge`` accepts, with all their columns and no new ones."""
    found = judge(docs, labels, key=key, text=text, lang=lang, **more)
    gone = written(found.where("not accepted").select(F.col(key).alias("__id"), F.col("mark").alias("__mark")).distinct(), "rejected")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark"))
    return docs.join(gone, same, "left_anti")
