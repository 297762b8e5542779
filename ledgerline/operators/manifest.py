"""Content hashes, work sizes, manifests and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.fixed_values import CHECK_NAME
from ledgerline.functions.jsontext import canonical_json, integrity, object_entries
from ledgerline.functions.text import character_count, content_hash, work_units
from ledgerline.operators.folds import Fold, final_states
from ledgerline.session import short_batches


def repo_chars(files: DataFrame, by: Sequence[str] = ("task_id",), text: str = "text") -> DataFrame:
    """Characters of each task's files joined by line feeds, without joining them."""
    joined = F.sum(character_count(text)) + F.count(F.lit(1)) - 1
    return files.filter(F.col(text).isNotNull()).groupBy(*by).agg(joined.alias("repo_chars"))


def work_size(tasks: DataFrame, repo: DataFrame | None = None) -> DataFrame:
    """Add ``work_chars``: characters of the instruction, the compact expected object and the repository.

    The repository is ``tasks.repo_text`` or the result of ``repo_chars``.
    """
    own = character_count("instruction") + character_count(canonical_json("expected"))
    if repo is None:
        return tasks.withColumn("work_chars", own + character_count(F.coalesce("repo_text", F.lit(""))))
    sized = tasks.join(repo, "task_id", "left")
    return sized.withColumn("work_chars", own + F.coalesce("repo_chars", F.lit(0))).drop("repo_chars")


def suite_size(sized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = sized.groupBy(*by).agg(F.sum("work_chars").alias("work_chars"))
    return total.withColumn("work_units", work_units("work_chars"))


def _entry(prompt_hash: Column) -> Column:
    """A task's part of the hashed suite body, as canonical JSON."""
    plain = F.to_json(
        F.struct(
            F.lit(CHECK_NAME).alias("check"),
            F.array_sort(F.map_keys(object_entries("expected"))).alias("expectedKeys"),
            F.col("task_id").cast("string").alias("id"),
            prompt_hash.alias("promptHash"),
        )
    )
    # Every object starts with "{": the two parts that to_json cannot write follow it.
    return canonical_json(F.concat(F.lit('{"mustInclude":null,"expectedJson":'), "expected", F.lit(","), F.substr(plain, F.lit(2))))


class _Sha256(Fold):
    """State: the digest of the pieces so far, joined by a separator, between an opening and a closing."""

    def __init__(self, piece: str, opening: str = "", separator: str = "", closing: str = ""):
        self.inputs, self.opening, self.separator, self.closing = (piece,), opening, separator, closing

    def fresh(self):
        return [hashlib.sha256(self.opening.encode()), ""]

    def step(self, state, piece):
        state[0].update((state[1] + piece).encode())
        state[1] = self.separator
        return ()

    def dump(self, state):
        state[0].update(self.closing.encode())
        return state[0].hexdigest()


def hash_of_pieces(pieces: DataFrame, by: Sequence[str], order: Sequence[str], piece: str, *marks: str) -> DataFrame:
    """``(by, state)``: SHA-256 of the pieces of each key, in order.

    The digest has to read a key from front to back, so one task streams it, in constant memory.
    """
    short_batches(pieces.sparkSession)
    return final_states(pieces, by, order, _Sha256(piece, *marks), max_rows=None)


def manifest(sized: DataFrame, by: Sequence[str], order: str = "task_id") -> DataFrame:
    """One row per suite: ``suite_hash`` over its tasks in order, ``work_chars``, ``work_units``, ``tasks`` (how many).

    ``sized``: tasks with task_id, instruction, expected and ``work_chars``; ``manifest_tasks`` has
    the rows of the single tasks. Tasks that ``manifest_rejects`` lists have no part in it.
    """
    by = list(by)
    sized = sized.filter(_sound())
    entries = manifest_tasks(sized, [*by, *dict.fromkeys([order])])
    hashes = hash_of_pieces(entries, by, [order], "entry", "[", ",", "]").withColumnRenamed("state", "suite_hash")
    sizes = sized.groupBy(*by).agg(F.sum("work_chars").alias("work_chars"), F.count(F.lit(1)).alias("tasks"))
    return hashes.join(sizes, by).withColumn("work_units", work_units("work_chars"))


def _sound() -> Column:
    return object_entries("expected").isNotNull() & F.col("task_id").isNotNull() & F.col("instruction").isNotNull()


def manifest_rejects(sized: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tasks that cannot stand in a manifest: without id or instruction, or with expected values that are no object."""
    return sized.filter(~F.coalesce(_sound(), F.lit(False))).select(*by, "task_id", "expected")


def manifest_tasks(sized: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Per task: ``prompt_hash``, ``work_chars`` and the canonical ``entry`` that goes into the suite's hash."""
    rows = sized.withColumn("prompt_hash", content_hash("instruction")).withColumn("entry", _entry(F.col("prompt_hash")))
    return rows.select(*dict.fromkeys([*keep, "task_id"]), "prompt_hash", "work_chars", "entry")


def package_integrity(packages: DataFrame, package: str = "package") -> DataFrame:
    """Add ``integrity``: the hash of the package's canonical JSON."""
    return packages.withColumn("integrity", integrity(package))


def verify_manifest(recorded: DataFrame, actual: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``(key, verdict)`` for every id on either side: ``ok``, ``changed``, ``missing`` or ``added``."""
    r = recorded.select(key, F.struct(*cols).alias("_recorded"))
    a = actual.select(key, F.struct(*cols).alias("_actual"))
    verdict = (
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("_recorded").isNull(), "added")
        .when(F.col("_recorded").eqNullSafe(F.col("_actual")), "ok")
        .otherwise("changed")
    )
    return r.join(a, key, "full_outer").select(key, verdict.alias("verdict"))
