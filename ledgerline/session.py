"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once. A task may feed several workers, and each holds its batch a few times
#: over (Arrow, Python's strings, results), so that Spark's 64 MB would take gigabytes of an executor.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str = "ledgerline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Partition counts and memory belong to the cluster; only semantics are pinned here: UTC, because
    ``timestamp_ntz`` columns are read as UTC, adaptive execution, and batches short enough for long texts.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(_BATCH, str(BATCH_BYTES))
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def short_batches(spark: SparkSession) -> None:
    """Long texts go to Python workers a few at a time, so that what a worker holds does not grow with the table."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a folder that other
    machines cannot see would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for results that are read more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
