"""Streams out to files, each row once however often a micro-batch is run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerline.session import scratch_path
from ledgerline.streaming.keyed import LATE

#: Folder of a table that holds one micro-batch, or one version of a bucket.
BATCH = "_batch"


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and return its output as a table.

    ``append`` goes through the Parquet sink, which is exactly-once. Any other mode keeps the output
    of each batch by its number, so that a batch run again overwrites itself, and returns it with ``_batch``.
    """
    out = scratch_path(stream.sparkSession, label)
    writer = stream.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def _by_batch(batch: DataFrame, path: str, number: int, *more: str) -> None:
    """``batch`` as the folders of its number: a batch that is run again overwrites its own folders and no others."""
    rows = batch.withColumn(BATCH, F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*more, BATCH).parquet(path)


def split_late(stream: DataFrame, on_time: str, late: str, progress: str, **trigger) -> StreamingQuery:
    """Write the rows of a stream that has ``late`` to two tables, each with ``_batch``."""

    def keep(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            _by_batch(held.filter(~F.col(LATE)).drop(LATE), on_time, number)
            _by_batch(held.filter(LATE).drop(LATE), late, number)
        finally:
            held.unpersist()

    return stream.writeStream.option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).foreachBatch(keep).start()


def latest_of(versions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; of equal ones, that of the later batch."""
    rest = [c for c in versions.columns if c not in keys]
    place = F.struct(*order, *([BATCH] if BATCH in rest and BATCH not in order else []))
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_row")).select(*keys, "_row.*")


def upsert_stream(
    stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], progress: str, buckets: int = 64, **trigger
) -> StreamingQuery:
    """Keep the last row of every key (by ``order``) in a table of buckets of keys; ``read_upserts`` reads it.

    A micro-batch touches the buckets of its keys only. Each gets a new version, a folder of the batch's number, made
    of the newest version from before that batch and the batch's rows. So a batch that is run again makes the
    same version again, and one that fails halfway leaves the versions before it as they were.
    """
    keys, order = list(keys), list(order)

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumns({"_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), BATCH: F.lit(number)})
        held = fresh.persist()
        try:
            touched = [r[0] for r in held.select("_bucket").distinct().collect()]  # so many at most as there are buckets
            if not touched:
                return
            rows, before = held, _newest(spark, path, touched, number)
            if before is not None:
                rows = rows.unionByName(before)
            last = latest_of(rows, [*keys, "_bucket"], order).withColumn("_from", F.col(BATCH))
            _by_batch(last.drop(BATCH).withColumnRenamed("_from", "_row_batch"), path, number, "_bucket")
        finally:
            held.unpersist()

    return stream.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()


def _versions(spark, path: str) -> dict[int, list[int]]:
    """Bucket to the numbers of its versions: names of folders, as many as there are buckets and versions."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_bucket=*/{BATCH}=*")
    found: dict[int, list[int]] = {}
    for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []:
        folder = f.getPath()
        found.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
    return found


def _newest(spark, path: str, touched: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The newest version of each bucket from before a batch, with the batch that each row came in."""
    found = {b: max(kept) for b, numbers in _versions(spark, path).items() if (touched is None or b in touched)
             and (kept := [n for n in numbers if before is None or n < before])}
    if not found:
        return None
    folders = [f"{path}/_bucket={b}/{BATCH}={n}" for b, n in sorted(found.items())]
    rows = spark.read.option("basePath", path).parquet(*folders)
    return rows.drop(BATCH).withColumnRenamed("_row_batch", BATCH)


def read_upserts(spark, path: str) -> DataFrame:
    """One row per key of a table that ``upsert_stream`` keeps."""
    rows = _newest(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return rows.drop("_bucket", BATCH)
