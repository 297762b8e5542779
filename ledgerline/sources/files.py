"""Run folders as tables.

``root`` holds one folder per run, with the folders of its attempts in it: ``root/<run>/[<task>/[<attempt>/]]…``, the
attempt a number. What lies at the top of an attempt's folder, or below a hidden folder there, is that attempt's; files
that stand in the run's own folder have no task and attempt 1. Tasks list the folders (``sources/folders.py``); the list
is kept, and only the contents of files that pass are read, by as many tasks as their bytes ask for. A file that cannot
be read is a row with an ``error`` and no text.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline import fixed_values as V
from ledgerline.functions.jsonshape import OUTSIDE, one_value, shape, shapes
from ledgerline.functions.keys import fold_key
from ledgerline.functions.text import file_stem, strip, task_tag
from ledgerline.operators.intervals import within
from ledgerline.session import staged
from ledgerline.sources.folders import opened, run_file_stream, run_files

ATTEMPT_KEYS = ["run_id", "task_id", "attempt"]
#: Bytes of files that a task reads, and of a split of a captured stream.
TASK_BYTES = SPLIT_BYTES = 32 << 20
_NO_FILES = "path string, modificationTime timestamp, length long, content binary"
#: A split of a stream's file: where it is, and where it begins and ends.
_SPLIT = "start long, stop long"


def _files(spark: SparkSession, paths: list[str], names: str = "*") -> DataFrame:
    """Files below the given path patterns; an empty table if there are none."""
    found = []
    for path in paths:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
        try:
            found.append(reader.load(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _NO_FILES)


def _below(root: str) -> Column:
    """Path below the root, whatever scheme Spark puts before it."""
    start = F.instr("path", root.rstrip("/") + "/") + len(root.rstrip("/")) + 1
    return F.substr("path", start)


def _text() -> Column:
    """Contents as text, with the replacement character for bytes that are no UTF-8."""
    return F.make_valid_utf8(F.col("content").cast("string"))


def _placed(files: DataFrame) -> DataFrame:
    """``task_id``, ``attempt`` and ``inner`` (the path within the attempt's folder) from the path within the run."""
    place = r"^(?:((?!std(?:out|err)(?:\.\w+)?/)[^._/][^/]*)/(?:(\d+)/)?)?(.*)$"
    return files.withColumns({
        "task_id": F.nullif(F.regexp_extract("file", place, 1), F.lit("")),
        "attempt": F.coalesce(F.regexp_extract("file", place, 2).try_cast("int"), F.lit(1)),
        "inner": F.regexp_extract("file", place, 3),
    })


def _tasks(bytes_: int | None, files: int, spark: SparkSession) -> int:
    """Tasks for so many bytes, no more than files."""
    return max(1, min(files, max(math.ceil((bytes_ or 0) / TASK_BYTES), spark.sparkContext.defaultParallelism)))


def _read(store: str, files: DataFrame) -> DataFrame:
    """Kept files with ``text``, or ``error``. The names are dealt out by bytes before any file is opened."""
    files = staged(files, "files")
    total, count = files.agg(F.sum("length"), F.count(F.lit(1))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, path in enumerate(batch.column("path").to_pylist()):
                row = batch.slice(n, 1)
                known, text, error = row.column("error").to_pylist()[0], None, None
                if known is None:
                    try:
                        with opened(store, path) as source:
                            text = source.read().decode("utf-8", "replace")
                    except OSError as problem:
                        error = str(problem)
                columns = [pa.array([text], pa.string()) if c == "text" else pa.array([known or error], pa.string()) if c == "error"
                           else row.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*files.columns, "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", text string"
    dealt = files.repartition(_tasks(total, count, files.sparkSession), "path")
    return dealt.mapInArrow(run, schema)


def session_logs(
    spark: SparkSession,
    root: str,
    since: dt.datetime | None = None,
    max_files: int | None = None,
    max_bytes: int | None = None,
    home: bool = False,
    max_depth: int | None = None,
    attempts: DataFrame | None = None,
) -> DataFrame:
    """Session transcripts as texts: ``run_id, task_id, attempt, source, file, stream, seq, text, error``.

    Files named like a session at the top of an attempt's folder, and all files below its hidden folders, hidden or
    not: JSON and JSON lines. ``home`` scans home folders instead, one per run: hidden folders only. A home file
    belongs to the attempts of ``attempts`` (``run_id, task_id, attempt, started``) during which it was changed last,
    from two seconds before an attempt's start to the start of the run's next one, so at times to two; without
    ``attempts`` it belongs to the run. ``since``: files changed since then, less two seconds. Everything is read unless
    a limit is given: ``max_bytes`` of a file, ``max_files`` of an attempt, the first by path, ``max_depth`` folders below
    a hidden one; ``left_out`` lists what limits leave out.
    """
    store, kept, inside = _session_files(spark, root, since, max_files, max_bytes, home, max_depth)
    files = kept.filter(inside)
    if home and attempts is not None:
        files = of_attempts(files.drop("task_id", "attempt"), attempts)
    rows = _read(store, files.select(*ATTEMPT_KEYS, "file", "path", "length", "error"))
    return rows.select(
        *ATTEMPT_KEYS, F.lit("home" if home else "session").alias("source"), "file", F.lit("file").alias("stream"),
        F.lit(0).cast("long").alias("seq"), "text", "error",
    )


def of_attempts(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """Files (``run_id``, ``modified_ms``) with the attempts of their run that they were changed in.

    An attempt lasts from two seconds before its start to the next start in its run. Files from before the first
    belong to none.
    """
    begun = attempts.select(*ATTEMPT_KEYS, F.unix_millis(F.col("started").cast("timestamp")).alias("_at"))
    order = Window.partitionBy("run_id").orderBy("_at", "task_id", "attempt")
    spans = begun.withColumn("end", F.lead("_at").over(order)).withColumn("start", F.col("_at") - 1000 * V.HOME_SLACK_SECONDS)
    return within(files, spans.drop("_at"), ["run_id"], "modified_ms").drop("start", "end")


def left_out(
    spark: SparkSession, root: str, since: dt.datetime | None = None, max_files: int | None = None,
    max_bytes: int | None = None, home: bool = False, max_depth: int | None = None,
) -> DataFrame:
    """``(run_id, task_id, attempt, file, length)`` of the transcripts that ``session_logs`` leaves out under these limits."""
    _, kept, inside = _session_files(spark, root, since, max_files, max_bytes, home, max_depth)
    return kept.filter(~inside).select(*ATTEMPT_KEYS, "file", "length")


def _session_files(spark, root, since, max_files, max_bytes, home, max_depth) -> tuple[str, DataFrame, Column]:
    """Where they are, the transcripts that are there, and which of them the limits let through."""
    store, listed = run_files(spark, root, skip=json.dumps(V.SKIPPED_FOLDERS))
    if home:
        found = listed.withColumns({"task_id": F.lit(None).cast("string"), "attempt": F.lit(1), "inner": F.col("file")})
    else:
        found = _placed(listed)
    parts = F.split("inner", "/")
    deep = (F.size(parts) > 1) & F.startswith("inner", F.lit("."))
    named = (F.size(parts) == 1) & F.expr(fold_key("_stem")).rlike("|".join(V.SESSION_NAME_WORDS))
    kept = found.withColumn("_stem", file_stem("inner")).withColumn("_deep", deep.cast("int"))
    wanted = F.lower("inner").rlike(r"\.jsonl?$") & (deep if home else deep | named)
    if since is not None:
        start = F.unix_millis(F.lit(since - dt.timedelta(seconds=V.HOME_SLACK_SECONDS)).cast("timestamp"))
        wanted = wanted & (F.col("modified_ms") >= start)
    kept = staged(kept.filter(wanted | F.col("error").isNotNull()), "listing")
    inside = F.lit(True)
    if max_bytes is not None:
        inside = inside & (F.coalesce("length", F.lit(0)) <= max_bytes)
    if max_depth is not None:  # below the hidden folder, which is a part of the path, as the file is
        inside = inside & (F.size(parts) <= max_depth + 2)
    if max_files is not None:
        # The cap is worked out on the listing, before any file is opened.
        by = Window.partitionBy(*ATTEMPT_KEYS).orderBy("_deep", "file")
        counted = kept.withColumn("_in", inside).withColumn("_nth", F.sum(F.col("_in").cast("long")).over(by))
        return store, counted, F.col("_in") & (F.col("_nth") <= max_files)
    return store, kept, inside


def _streams(files: DataFrame) -> DataFrame:
    """``run_id``, ``task_id``, ``attempt``, ``file`` and ``stream`` of captured streams.

    They stand in ``root/<run>/[<task>/[<attempt>/]]stdout`` or ``stderr``, with any one suffix: a file, or a folder
    of files.
    """
    place = r"^((?:[^/]+/)*?)(stdout|stderr)(?:\.\w+)?(?:/([^/]+))?$"
    folders = F.split(F.concat(F.regexp_extract("file", place, 1), F.lit("-")), "/")
    part = lambda n: F.when(F.size(folders) > n + 1, F.get(folders, F.lit(n)))
    found = files.withColumns({
        "stream": F.regexp_extract("file", place, 2), "task_id": part(0), "attempt": F.coalesce(part(1).try_cast("int"), F.lit(1)),
        "source": F.lit("cli"),
    })
    in_folder = F.regexp_extract("file", place, 3)  # what writers leave beside their part files is no part of a stream
    return found.filter((F.col("stream") != "") & ~in_folder.rlike("^[._]"))


_STREAM = ("run_id", "task_id", "attempt", "source", "file", "stream", "seq")
_STREAM_DEPTH = {"depth": 3, "hidden": "false"}


def log_texts(spark: SparkSession, root: str) -> DataFrame:
    """Captured streams as whole texts, one row per file, for values that span lines. ``log_lines`` splits them."""
    store, files = run_files(spark, root, **_STREAM_DEPTH)
    kept = _streams(files).select(*_STREAM[:-1], "path", "length", "error")
    return _read(store, kept).withColumn("seq", F.lit(0).cast("long")).select(*_STREAM, "text", "error")


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Captured streams line by line, as ``log_texts``, but ``seq`` is the byte that a line begins at and ``next`` the one
    after it, so that lines of a file are known to follow each other. Long files are split among tasks.

    A file that is one JSON value over several lines is one row, with ``whole``; that it is one is found out in pieces.
    """
    store, files = run_files(spark, root, **_STREAM_DEPTH)
    kept = staged(_streams(files).select(*_STREAM[:-1], "path", "length", "error"), "files")
    total, count = kept.agg(F.sum("length"), F.count(F.lit(1))).first()
    tasks = lambda b, n: _tasks(b, max(n, math.ceil((b or 0) / SPLIT_BYTES)), spark)
    began = staged(_begun(store, kept.repartition(tasks(0, count), "path")), "begun")  # those that may be one value
    some, held = began.agg(F.count(F.lit(1)), F.sum("length")).first()
    whole = staged(_wholes(store, began, tasks(held, some)), "whole") if some else None
    lined = kept if whole is None else kept.join(whole, "path", "left_anti")
    lines = _lines(store, _splits(lined).repartition(tasks(total, count), "path", "start")).withColumn("whole", F.lit(False))
    if whole is None:
        return lines
    texts = _read(store, kept.join(whole, "path"))
    return lines.unionByName(texts.select(
        *_STREAM[:-1], F.lit(0).cast("long").alias("seq"), F.col("length").alias("next"), "text", "error", F.lit(True).alias("whole")
    ))


def _begun(store: str, files: DataFrame) -> DataFrame:
    """``(path, length)`` of files that begin with a bracket which their first line does not close."""

    def opens(path: str) -> bool:
        with opened(store, path) as source:
            data = b""
            while b"\n" not in data.lstrip():
                more = source.read(1 << 16)
                if not more:
                    return False
                data = data.lstrip() + more
        line = data.lstrip().split(b"\n", 1)[0]
        return line[:1] in (b"{", b"[") and not one_value([(False, shapes(line, True))]) and shape(line, OUTSIDE)[1] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for path, error in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist()):
                try:
                    keep.append(error is None and opens(path))
                except OSError:
                    keep.append(False)  # reading it as lines gives the error
            yield batch.select(["path", "length"]).filter(pa.array(keep, pa.bool_()))

    return files.mapInArrow(run, "path string, length long")


_SHAPE = "array<struct<state: int, depth: int, low: int, seen: boolean, last: boolean>>"


def _wholes(store: str, files: DataFrame, tasks: int) -> DataFrame:
    """``path`` of the files whose brackets make one value, each summarised in pieces by as many tasks as there are."""
    names = ("state", "depth", "low", "seen", "last")
    made = T.StructType.fromDDL(f"path string, start long, blank boolean, shapes {_SHAPE}")
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                try:
                    with opened(store, path) as source:
                        source.seek(start)
                        piece = source.read(stop - start)
                except OSError:
                    continue
                rows = [{"path": path, "start": start, "blank": not piece.strip(), "shapes": [dict(zip(names, x)) for x in shapes(piece, start == 0)]}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    pieces = _splits(files).repartition(tasks, "path", "start").mapInArrow(run, made)
    each = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "blank", "shapes"))).alias("pieces"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(p["blank"], [tuple(x[n] for n in names) for x in p["shapes"]]) for p in row] for row in batch.column("pieces").to_pylist()]
            yield batch.select(["path"]).filter(pa.array([one_value(r) for r in rows], pa.bool_()))

    return each.mapInArrow(fold, "path string")


def log_line_stream(spark: SparkSession, root: str, **options) -> DataFrame:
    """``log_lines`` of the files that are changed while a stream runs.

    A file that grew is read again from its start, and its lines come again with the same places:
    ``harvest_stream`` lets them take the place of the earlier ones. ``settle_ms``: how long a file must have stayed as it
    is before it is read.
    """
    store, files = run_file_stream(spark, root, **_STREAM_DEPTH, **options)
    kept = _streams(files).select(*_STREAM[:-1], "path", "length", "error")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _lines(store, _splits(kept).repartition(tasks, "path", "start"))


def _splits(files: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce("length", F.lit(0)) - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("long"))
    return files.withColumn("start", F.explode(starts)).withColumn("stop", F.least(F.col("start") + SPLIT_BYTES, "length"))


def split_lines(source, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """``(first byte, line with its end)`` of the lines that begin in ``[start, stop)``; the last one is read to its end."""
    at = max(start - 1, 0)
    source.seek(at)
    data = source.read(stop - at)
    while data and not data.endswith(b"\n"):  # what begins before the border goes on beyond it
        more = source.read(1 << 20)
        cut = more.find(b"\n")
        data += more if cut < 0 else more[: cut + 1]
        if not more or cut >= 0:
            break
    for n, line in enumerate(data.splitlines(keepends=True)):
        if at >= stop:
            break
        if n or start == 0:  # the first line of a later split began before it, if only its end is in it
            yield at, line
        at += len(line)


def _lines(store: str, splits: DataFrame) -> DataFrame:
    keep = [*_STREAM[:-1]]
    schema = "run_id string, task_id string, attempt int, source string, file string, stream string, seq long, next long, text string, error string"

    def packed(row: pa.RecordBatch, places: list[int], lines: list[bytes], error: str | None = None) -> pa.RecordBatch:
        n = max(len(places), error is not None)
        columns = [row.column(c).take(pa.array([0] * n, pa.int32())) for c in keep]
        texts = [line.rstrip(b"\r\n").decode("utf-8", "replace") for line in lines]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(places or [None] * n, pa.int64()), pa.array([p + len(x) for p, x in zip(places, lines)] or [None] * n, pa.int64()),
             pa.array(texts or [None] * n, pa.string()), pa.array([error] * n, pa.string())],
            names=[*keep, "seq", "next", "text", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (path, start, stop, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "error")))):
                row, places, lines = batch.slice(n, 1), [], []
                if known is not None:
                    yield packed(row, [], [], known)
                    continue
                try:
                    with opened(store, path) as source:
                        for place, line in split_lines(source, start, stop):
                            places.append(place)
                            lines.append(line)
                            if len(lines) == 10_000:
                                yield packed(row, places, lines)
                                places, lines = [], []
                except OSError as problem:
                    yield packed(row, [], [], str(problem))
                if lines:
                    yield packed(row, places, lines)

    return splits.mapInArrow(run, schema)


def _of_workspace(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Files of these names at the top of attempts' folders, read."""
    store, files = run_files(spark, root, depth=2, hidden="false")
    found = _placed(files).filter(F.col("inner").isin(names) | F.col("error").isNotNull())
    return _read(store, found.select(*ATTEMPT_KEYS, "inner", "path", "length", "error"))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """``usage.json`` of every attempt as ``run_id, task_id, attempt, text, error``."""
    return _of_workspace(spark, root, ["usage.json"]).select(*ATTEMPT_KEYS, "text", "error")


def _each(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` for every row of ``wanted`` by the attempt columns that it has; by run alone, the run's own files."""
    keys = [c for c in ATTEMPT_KEYS if c in wanted.columns]
    own = found if "task_id" in keys else found.filter("task_id is null")
    named = own.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in own.columns if c not in ATTEMPT_KEYS])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return wanted.select(*keys).join(named, same, "left").drop(*[f"_{k}" for k in keys])


def report_texts(spark: SparkSession, root: str, attempts: DataFrame) -> DataFrame:
    """``text`` for every row of ``attempts`` (``run_id``, or all three keys): its ``reward.json``, null if it has none."""
    found = _of_workspace(spark, root, ["reward.json"])
    return _each(attempts, found.select(*ATTEMPT_KEYS, "text"))


def answers(spark: SparkSession, root: str, attempts: DataFrame) -> DataFrame:
    """``output`` for every row of ``attempts``: its ``answer.json``, else ``out.json``, else empty."""
    found = _of_workspace(spark, root, ["answer.json", "out.json"]).filter("text is not null")
    # Two files at most per attempt.
    best = found.groupBy(*ATTEMPT_KEYS).agg(F.min_by("text", "inner").alias("output"))
    return _each(attempts, best).withColumn("output", F.coalesce("output", F.lit("")))


def task_files(spark: SparkSession, root: str, repo: str = "environment/repo") -> DataFrame:
    """Repository files of task folders: ``task_folder, path, text``; files that are no UTF-8 are left out."""
    found = _files(spark, [f"{root.rstrip('/')}/*/{repo}"]).withColumn("_rel", _below(root))
    rows = found.select(
        F.substring_index("_rel", "/", 1).alias("task_folder"),
        F.regexp_replace("_rel", f"^[^/]*/{repo}/", "").alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    )
    return rows.filter("text is not null")


def task_definitions(spark: SparkSession, root: str) -> DataFrame:
    """``task_folder, task_id, label, instruction, expected`` per folder of ``root``."""
    names = ["instruction.md", "expected.json", "id.txt", "label.txt"]
    base = root.rstrip("/")
    found = _files(spark, [f"{base}/*/{n}" for n in names]).withColumn("_rel", _below(base))
    # Four files at most per folder.
    by_name = found.groupBy(F.substring_index("_rel", "/", 1).alias("task_folder")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.substring_index("_rel", "/", -1), _text()))).alias("f")
    )
    part = lambda n: F.try_element_at("f", F.lit(n))
    return by_name.filter(part("instruction.md").isNotNull()).select(
        "task_folder",
        task_tag("task_folder", part("id.txt")).alias("task_id"),
        F.coalesce(strip(part("label.txt")), F.col("task_folder")).alias("label"),
        F.regexp_replace(part("instruction.md"), r"\r\n?", "\n").alias("instruction"),
        part("expected.json").alias("expected"),
    )
