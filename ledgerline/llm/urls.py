"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule covers.

Everything is a DataFrame expression or Spark's own tree learner; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Labelled URLs that the trees are trained on, at most; those with the smallest hashes.
TRAIN_ROWS = 50_000
TREES, DEPTH = 12, 4
#: Suffixes whose statistics are sent to all executors, with their characters; above, those with more URLs than
#: ``HOT_URLS`` are sent, at most ``BROADCAST_SUFFIXES`` of them, and the others are joined by shuffle.
BROADCAST_SUFFIXES, BROADCAST_CHARS, HOT_URLS = 100_000, 4 << 20, 10_000
FEATURES = (
    "length host_length path_length depth labels digit_ratio entropy parameters query_length hyphens fragment "
    "extension suffix_rate suffix_share"
).split()


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(u.contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruling(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else nulls; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for word, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(rows: DataFrame) -> DataFrame:
    """Lexical features of ``rows(url, host, path)``."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    share = F.transform(
        F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    )
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return rows.withColumns(
        {
            "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "labels": F.size(F.split("host", r"\.")),
            "digit_ratio": digits / size, "entropy": entropy,
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
            "hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
            "fragment": url.contains("#").cast("int"), "extension": F.col("path").rlike(r"\.\w+$").cast("int"),
        }
    )


def _with_suffixes(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the statistics of their suffix, all of which ``table`` has.

    Suffixes of many URLs never meet in a shuffle: they are broadcast apart from the others.
    """
    kinds, chars = table.agg(F.count("*"), F.sum(F.length("suffix"))).first()
    if kinds <= BROADCAST_SUFFIXES and (chars or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(table.drop("n")), "suffix")
    hot = table.where(F.col("n") > HOT_URLS).orderBy(F.col("n").desc(), "suffix").limit(BROADCAST_SUFFIXES)
    hot = F.broadcast(written(hot.drop("n"), "hot"))
    rest = table.drop("n").join(hot.select("suffix"), "suffix", "left_anti")
    few = rows.join(hot.select("suffix"), "suffix", "left_anti").join(rest.hint("shuffle_merge"), "suffix")
    return rows.join(hot, "suffix").unionByName(few)


def judge_urls(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``(key, host, path, rule, verdict, p_block)`` per row: the rule's verdict, else that of the trees.

    The trees learn from the URLs that a rule covers, ``TRAIN_ROWS`` at most. Suffix statistics are the smoothed
    rate of blocked ones among a suffix's labelled URLs and the suffix's share of all URLs. Null URLs and those
    without ``://`` have an empty host and path; they fit no rule that has either, and the trees judge them.
    If the labelled URLs are missing or all alike, their verdict, or else ``allow``, goes to all others.
    Repeated rows are judged each. Columns other than key and URL are not read. An empty table stays empty.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "suffix": _suffix(F.col("host"))})
    by_suffix = written(
        rows.groupBy("suffix").agg(
            F.count("*").alias("n"), F.count("ruled").alias("known"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        ),
        "suffixes",
    )
    total, known, blocked = by_suffix.agg(F.sum("n"), F.sum("known"), F.sum("blocked")).first()
    kept = rows.select("key", "url", "host", "path", "rule", "ruled", "suffix")
    if not known or blocked in (0, known):
        only = "block" if known and blocked else "allow"
        out = kept.withColumn("p_block", F.lit(float(only == "block")))
    else:
        prior = blocked / known
        table = by_suffix.select(
            "suffix", "n", ((F.col("blocked") + 10 * prior) / (F.col("known") + 10)).alias("suffix_rate"),
            (F.col("n") / float(total)).alias("suffix_share"),
        )
        full = lexical(_with_suffixes(kept, table))
        seen = F.struct(*(F.col(f).cast("double").alias(f) for f in FEATURES)).alias("x")
        train = written(
            full.where("ruled is not null").select(
                F.xxhash64("url").alias("h"), (F.col("ruled") == "block").cast("double").alias("y"), seen
            ).orderBy("h", "y").limit(TRAIN_ROWS),
            "labelled",
        ).select("y", "x.*")
        pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(
            labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxMemoryInMB=64
        ).fit(pack.transform(train).select("y", "features"))
        judged = trees.transform(pack.transform(full.withColumns({f: F.col(f).cast("double") for f in FEATURES})))
        out = judged.withColumn("p_block", vector_to_array("probability")[1])
    learned = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "p_block"
    )
