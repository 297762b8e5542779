"""Folders of runs as a data source, for batches and streams.

``root`` holds one folder per run. The driver lists the names in ``root`` and nothing below; the runs are dealt to tasks,
which walk their folders, hidden ones too, and give a row per file. A folder that cannot be listed is a row with an
error. Names are taken as they are: no patterns, no escapes.

A stream gives the files that were changed since the batch before, by their time of change. Its offset is a time, so it
does not grow with the files. A file that grew comes again, whole.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import lru_cache

import pyarrow.fs as pa_fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "run_files"
SCHEMA = "run_id string, file string, path string, length long, modified_ms long, error string"
#: Schemes of Hadoop and what Arrow calls them.
_ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def resolved(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """``(store, path)`` of a root that may be a link or a mount; null if there is no such folder.

    The store is empty for local files, else a scheme and an authority that Arrow opens.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        uri = system.resolvePath(path).toUri()
    except Py4JJavaError as error:
        if "FileNotFound" in error.java_exception.getClass().getName():
            return None
        raise
    scheme = uri.getScheme() or "file"
    if scheme == "file":
        return "", uri.getPath()
    return f"{_ARROW_SCHEMES.get(scheme, scheme)}://{uri.getAuthority() or ''}", uri.getPath()


@lru_cache(maxsize=16)
def _system(store: str) -> tuple[pa_fs.FileSystem, str]:
    if not store:
        return pa_fs.LocalFileSystem(), ""
    system, prefix = pa_fs.FileSystem.from_uri(f"{store}/")
    return system, prefix.rstrip("/")


def opened(store: str, path: str):
    """The file as a seekable stream."""
    system, prefix = _system(store)
    return system.open_input_file(prefix + path)


def save(store: str, path: str, content: bytes) -> None:
    """Write a file, and the folders above it."""
    system, prefix = _system(store)
    system.create_dir((prefix + path).rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(prefix + path) as sink:
        sink.write(content)


class _Runs(InputPartition):
    def __init__(self, names: list[str], after: int | None = None, until: int | None = None):
        self.names, self.after, self.until = names, after, until


class _Walker:
    """Options: ``store`` and ``path`` of the root, ``skip`` (folders left out, as JSON), ``depth`` (folders below a run
    that are entered), ``hidden`` (whether hidden folders are), ``tasks``."""

    def __init__(self, options):
        self.store, self.root = options.get("store", ""), options["path"].rstrip("/")
        self.skip = frozenset(json.loads(options.get("skip", "[]")))
        self.depth, self.hidden = int(options.get("depth", 1_000)), options.get("hidden", "true") == "true"
        self.tasks = int(options.get("tasks", 64))

    def dealt(self, after: int | None = None, until: int | None = None) -> list[_Runs]:
        system, prefix = _system(self.store)
        found = system.get_file_info(pa_fs.FileSelector(prefix + self.root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == pa_fs.FileType.Directory)
        tasks = min(self.tasks, len(names)) or 1
        return [_Runs(names[n::tasks], after, until) for n in range(tasks)]

    def read(self, part: _Runs) -> Iterator[tuple]:
        system, prefix = _system(self.store)
        for run in part.names:
            top = f"{prefix}{self.root}/{run}"
            pending = [(top, 0)]
            while pending:
                folder, depth = pending.pop()
                try:
                    found = system.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True))
                except OSError as error:
                    yield run, folder[len(top) + 1 :], folder[len(prefix) :], None, None, str(error)
                    continue
                for f in found:
                    if f.type == pa_fs.FileType.Directory:
                        if depth < self.depth and f.base_name not in self.skip and (self.hidden or f.base_name[0] not in "._"):
                            pending.append((f.path, depth + 1))
                    elif f.type == pa_fs.FileType.File:
                        changed = (f.mtime_ns or 0) // 1_000_000
                        if part.until is None or part.after < changed <= part.until:
                            yield run, f.path[len(top) + 1 :], f.path[len(prefix) :], f.size, changed, None


class _Reader(_Walker, DataSourceReader):
    def partitions(self):
        return self.dealt()


class _StreamReader(_Walker, DataSourceStreamReader):
    """``settle_ms``: how long a file must have stayed as it is before it is read."""

    def __init__(self, options):
        super().__init__(options)
        self.settle = int(options.get("settle_ms", 1_000))

    def initialOffset(self):
        return {"ms": -1}

    def latestOffset(self):
        return {"ms": time.time_ns() // 1_000_000 - self.settle}

    def partitions(self, start, end):
        return self.dealt(start["ms"], end["ms"]) if end["ms"] > start["ms"] else []

    def commit(self, end):
        pass


class RunFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def _options(spark: SparkSession, place: tuple[str, str], options: dict) -> dict:
    spark.dataSource.register(RunFiles)
    spread = {"tasks": 4 * spark.sparkContext.defaultParallelism, "store": place[0], "path": place[1]}
    return {k: str(v) for k, v in (spread | options).items()}


def run_files(spark: SparkSession, root: str, **options) -> tuple[str, DataFrame]:
    """``(store, files)``: where the files are opened, and a row per file of every run; see ``_Walker`` for options."""
    place = resolved(spark, root)
    if place is None:
        return "", spark.createDataFrame([], SCHEMA)
    return place[0], spark.read.format(FORMAT).options(**_options(spark, place, options)).load()


def run_file_stream(spark: SparkSession, root: str, **options) -> tuple[str, DataFrame]:
    """``run_files`` as a stream; the root must be there."""
    place = resolved(spark, root)
    if place is None:
        raise FileNotFoundError(root)
    return place[0], spark.readStream.format(FORMAT).options(**_options(spark, place, options)).load()
