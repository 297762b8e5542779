"""Result tables and packages on their way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.jsontext import canonical_json
from ledgerline.functions.keys import BUCKETS
from ledgerline.functions.text import slug
from ledgerline.operators.manifest import hash_of_pieces
from ledgerline.operators.scoring import run_totals
from ledgerline.session import checkpointed, short_batches
from ledgerline.sources.folders import resolved, save

OUTWARD = {"cache_hit": "cacheHit", "cache_write": "cacheWrite"}


def usage_json(usage: Column) -> Column:
    """The five counts under their outward names, as a struct."""
    return F.struct(*[F.coalesce(usage[b], F.lit(0)).cast("long").alias(OUTWARD.get(b, b)) for b in BUCKETS])


def packages(sealed: DataFrame, runs: DataFrame, suite: dict[str, str], order: str = "task_id") -> DataFrame:
    """Sealed JSON packages in pieces: ``run_id, name, part, place, task_id, piece``, in (part, place, task_id) order.

    ``order`` is the column of ``sealed`` by which the tasks of a run stand in its package; the hash depends on it. The pieces of a run make up one canonical JSON document: a head, one piece per task and a tail
    with the totals and the integrity hash. No run has to fit in one row.

    ``runs``: run_id, started_at, finished_at and a ``stack`` struct with modelSlug, harnessSlug and
    setting. ``suite``: format, evaluator, evaluatorVersion, suiteVersion, suiteHash.
    """
    short_batches(sealed.sparkSession)
    task = F.struct(
        F.col("task_id").cast("string").alias("id"), F.col("prompt_hash").alias("promptHash"), "output",
        F.col("output_hash").alias("outputHash"), usage_json(F.col("usage")).alias("usage"),
        F.when(F.col("provider_source").isNotNull(), F.struct(F.col("provider_source").alias("source"))).alias("providerUsage"),
        "passed", "check", "attempts",
    )
    totals = run_totals(sealed, ["run_id"], F.min(F.struct(F.col(order).alias("place"), F.col("task_id").alias("id"))).alias("_first"))
    totals = totals.withColumn("totals", F.struct("tasks", "passed", *[F.col(b).alias(OUTWARD.get(b, b)) for b in BUCKETS]))
    joined = runs.join(totals.select("run_id", "totals", "_first"), "run_id")
    name = F.concat_ws("-", slug("stack.modelSlug"), "stack.harnessSlug", "stack.setting").alias("name")

    def fixed(**values: str) -> Column:
        return _canonical(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))

    # Canonical JSON sorts its keys: evaluator, format, run (with its tasks), stack, suite…, totals.
    head = F.concat(
        F.lit('{"evaluator":'), fixed(name=suite["evaluator"], version=suite["evaluatorVersion"]), F.lit(","),
        _members(fixed(format=suite["format"])), F.lit(',"run":{'),
        _members(_canonical(F.struct(F.col("finished_at").alias("finishedAt"), F.col("started_at").alias("startedAt")))),
        F.lit(',"tasks":['),
    )
    tail = F.concat(
        F.lit(']},"stack":'), _canonical(F.col("stack")), F.lit(","),
        _members(fixed(suiteHash=suite["suiteHash"], suiteVersion=suite["suiteVersion"])),
        F.lit(',"totals":'), _canonical(F.col("totals")), F.lit("}"),
    )
    ends = joined.select("run_id", name, "_first", head.alias("head"), tail.alias("tail"))
    comma = F.when(F.struct(F.col("place"), F.col("task_id").alias("id")) > F.col("_first"), ",").otherwise("")
    body = sealed.select("run_id", "task_id", F.col(order).alias("place"), _canonical(task).alias("_task"))
    body = body.join(ends.select("run_id", "name", "_first"), "run_id")
    body = body.select("run_id", "name", F.lit(1).alias("part"), "place", "task_id", F.concat(comma, "_task").alias("piece"))
    both = F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.col(c).alias("piece")) for n, c in ((0, "head"), (2, "tail"))]))
    # Read twice below, for the hash and for the result.
    pieces = checkpointed(body.unionByName(ends.select("run_id", "name", both), allowMissingColumns=True))
    integrity = hash_of_pieces(pieces, ["run_id"], ["part", "place", "task_id"], "piece")
    signed = F.concat(F.rtrim("piece", F.lit("}")), F.lit('},"integrity":"'), "state", F.lit('"}'))
    return pieces.join(integrity, "run_id").withColumn("piece", F.when(F.col("part") == 2, signed).otherwise(F.col("piece"))).drop("state")


def _canonical(value: Column) -> Column:
    return canonical_json(F.to_json(value, {"ignoreNullFields": "false"}))


def _members(obj: Column) -> Column:
    """A JSON object without its braces."""
    return F.substr(obj, F.lit(2), F.char_length(obj) - 2)


def write_packages(packed: DataFrame, path: str) -> None:
    """A folder per run and name below ``path`` with one file, whose lines are the pieces of its package."""
    laid = packed.repartition("run_id").sortWithinPartitions("run_id", "name", "part", "place", "task_id")
    rows = laid.select("run_id", "name", F.col("piece").alias("value"))
    rows.write.partitionBy("run_id", "name").mode("overwrite").text(path)


def write_usage(usages: DataFrame, path: str, by: list[str]) -> None:
    """Usage under its outward names, one JSON object per row in folders by key, a file each."""
    out = usages.select(*by, usage_json(F.col("usage")).alias("_u")).select(*by, "_u.*")
    out.repartition(*by).write.partitionBy(*by).mode("overwrite").json(path)



def write_files(files: DataFrame, root: str) -> None:
    """Small files under names of their own: ``path`` (below ``root``) and ``text``, written by the tasks that hold the rows.

    For layouts that others prescribe; a table belongs into Spark's own writers. A file that is there is replaced, so a
    task that is run again leaves the same files.
    """
    spark = files.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    store, top = resolved(spark, root)

    def put(rows) -> None:
        for row in rows:
            save(store, f"{top.rstrip('/')}/{row.path}", row.text.encode())

    files.select("path", "text").foreachPartition(put)
