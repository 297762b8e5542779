"""Scoring of outputs against expected values, and rollups of attempts and runs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.fixed_values import CHECK_NAME, DEFAULT_HINT, HINTS
from ledgerline.functions.jsontext import decoded_string, extract_json_object, object_entries
from ledgerline.functions.keys import BUCKETS
from ledgerline.functions.text import content_hash, strip
from ledgerline.operators.tally import saturated_sum
from ledgerline.session import short_batches

RUN, TASK = ["run_id"], ["run_id", "task_id"]

# A table is broadcast only when it is found to be below both bounds; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small. Reads no more rows than the bound."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df


def values_match(expected: Column, actual: Column) -> Column:
    """Whether two JSON values (as ``object_entries`` writes them) agree.

    Numbers agree within 1e-6, strings without regard to case and outer blanks, a boolean with
    itself and with 1 or 0, everything else when equal.
    """
    number, text = r"^-?[0-9NI]", '^"'
    close = F.abs(expected.try_cast("double") - actual.try_cast("double")) <= 1e-6
    alike = F.lower(strip(decoded_string(expected))) == F.lower(strip(decoded_string(actual)))
    plain = lambda v: F.when(v == "true", "1").when(v == "false", "0").otherwise(v)
    return F.coalesce(
        F.when(expected.rlike(number) & actual.rlike(number), close)
        .when(expected.rlike(text) & actual.rlike(text), alike)
        .otherwise(plain(expected) == plain(actual)),
        F.lit(False),
    )


def expected_entries(tasks: DataFrame, key: str = "task_id", expected: str = "expected") -> DataFrame:
    """``(task, entries)``: each task's expected object as a map of JSON values."""
    return tasks.select(key, object_entries(expected).alias("_expected"))


def score_outputs(outputs: DataFrame, tasks: DataFrame, key: str = "task_id", output: str = "output") -> DataFrame:
    """Add ``passed``: the output holds a non-empty object with every expected value of its task.

    Rows of unknown tasks are left out; ``unknown_tasks`` lists them.
    """
    short_batches(outputs.sparkSession)
    joined = outputs.join(small(expected_entries(tasks, key)), key)
    got = joined.withColumn("_got", object_entries(extract_json_object(output)))
    each = F.forall(
        F.map_entries("_expected"),
        lambda e: F.coalesce(
            F.map_contains_key("_got", e["key"]) & values_match(e["value"], F.try_element_at(F.col("_got"), e["key"])),
            F.lit(False),
        ),
    )
    passed = F.coalesce((F.size("_got") > 0) & each, F.lit(False))
    return got.withColumn("passed", passed).drop("_got", "_expected")


def unknown_tasks(raw: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows whose task has no definition."""
    return raw.join(small(tasks.select(key)), key, "left_anti")


def seal_tasks(raw: DataFrame, tasks: DataFrame) -> DataFrame:
    """One sealed row per known raw row.

    ``raw``: run_id, task_id, output, usage struct (nullable counts), attempts, provider_source.
    ``tasks``: task_id, prompt_hash, expected. The pass flag is worked out again from the output.
    """
    specs = tasks.select("task_id", "prompt_hash", "expected")
    known = raw.withColumn("output", F.coalesce("output", F.lit("")))
    scored = score_outputs(known, specs).join(small(specs.drop("expected")), "task_id")
    usage = F.struct(*[F.coalesce(F.col(f"usage.{b}"), F.lit(0)).cast("long").alias(b) for b in BUCKETS])
    return scored.select(
        "run_id", "task_id", "prompt_hash", "output",
        content_hash("output").alias("output_hash"),
        usage.alias("usage"),
        "provider_source", "passed",
        F.lit(CHECK_NAME).alias("check"),
        F.greatest(F.lit(1), F.coalesce(F.col("attempts"), F.lit(1))).cast("long").alias("attempts"),
    )


def run_totals(sealed: DataFrame, by: Sequence[str] = RUN, *more: Column) -> DataFrame:
    """Tasks, passes and the five token sums per run (or any coarser grouping), and ``more`` aggregates.

    Sums stop at the largest 64-bit integer.
    """
    return sealed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("passed").alias("passed"),
        *[saturated_sum(F.col(f"usage.{b}")).alias(b) for b in BUCKETS],
        *more,
    )


def rank_eligibility(totals: DataFrame) -> DataFrame:
    """Add ``rankable``: every task passed and some tokens were counted. No tokens is not free."""
    spent = functools.reduce(Column.__or__, [F.coalesce(F.col(b) > 0, F.lit(False)) for b in BUCKETS])
    return totals.withColumn("rankable", (F.col("passed") == F.col("tasks")) & spent)


def attempts_to_pass(
    attempts: DataFrame, by: Sequence[str] = TASK, attempt: str = "attempt", passed: str = "passed", cap: int = 0
) -> DataFrame:
    """Per task: whether it passed and on which attempt the loop ended. ``cap`` 0 means no cap."""
    rows = attempts if cap <= 0 else attempts.filter(F.col(attempt) <= cap)
    first = F.min(F.when(F.col(passed), F.col(attempt)))
    return rows.groupBy(*by).agg(
        first.isNotNull().alias("passed"), F.coalesce(first, F.max(attempt)).alias("attempts")
    )


def attempts_run(attempts: DataFrame, by: Sequence[str] = TASK, attempt="attempt", passed="passed", cap: int = 0) -> DataFrame:
    """The attempts the loop makes: up to the first pass, or the cap."""
    ends = attempts_to_pass(attempts, by, attempt, passed, cap).select(*by, F.col("attempts").alias("_end"))
    return attempts.join(ends, list(by)).filter(F.col(attempt) <= F.col("_end")).drop("_end")


def latest_attempt(df: DataFrame, by: Sequence[str] = TASK, attempt: str = "attempt") -> DataFrame:
    """The row of the last attempt per task. One combined aggregate, no window."""
    rest = [c for c in df.columns if c not in by]
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(attempt)).alias("_last"))
    return last.select(*by, "_last.*")


def test_pass_rate(reports: DataFrame) -> DataFrame:
    """Per report: passed and total tests and their rate; a report without tests goes by its ok flag."""
    failed = listed(F.col("failedTests"), F.col("errors"))
    n_pass = F.coalesce(F.size(F.col("passedTests")), F.lit(0))
    n_pass = F.when(n_pass < 0, 0).otherwise(n_pass).cast("long")
    total = n_pass + F.size(failed)
    rate = F.when(total > 0, n_pass / total).otherwise(F.coalesce(F.col("ok"), F.lit(False)).cast("double"))
    return reports.withColumns({"tests_passed": n_pass, "tests_total": total.cast("long"), "pass_rate": rate})


def listed(first: Column, second: Column) -> Column:
    """The first list unless it is missing or empty, then the second, then an empty one."""
    empty = F.array().cast("array<string>")
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(empty)


def pass_rate_by_test(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each named test passed."""
    empty = F.array().cast("array<string>")
    passes = F.transform(F.coalesce("passedTests", empty), lambda t: F.struct(t.alias("test"), F.lit(1).alias("ok")))
    fails = F.transform(
        listed(F.col("failedTests"), F.col("errors")), lambda t: F.struct(t.alias("test"), F.lit(0).alias("ok"))
    )
    rows = reports.select(*by, F.inline(F.concat(passes, fails)))
    return rows.groupBy(*by, "test").agg(F.sum("ok").alias("passes"), F.count(F.lit(1)).alias("runs"))


def known_hints(spark: SparkSession) -> DataFrame:
    """The fixed hints as ``(test, hint)``."""
    return spark.createDataFrame(list(HINTS.items()), "test string, hint string")


def failure_hints(reports: DataFrame, by: Sequence[str], hints: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row per listed failed test of a report, in order, with its hint; the first ``limit`` only if one is given.

    ``hints(test, hint)``, by default the fixed ones; a test without one gets the default text.
    """
    hints = known_hints(reports.sparkSession) if hints is None else hints
    failed = listed(F.col("failedTests"), F.col("errors"))
    failed = failed if limit is None else F.slice(failed, 1, limit)
    rows = reports.select(*by, F.posexplode(failed).alias("place", "test"))
    return rows.join(small(hints.select("test", "hint")), "test", "left").withColumn(
        "hint", F.coalesce("hint", F.lit(DEFAULT_HINT))
    )


