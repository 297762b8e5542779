"""The usage of a stretch of a text, as a summary that merges with that of the next stretch.

Turns are added up, or the last one stands if ``input`` never falls; sessions compete by richness. All of that can be
told of a stretch from its first and last turn, its sums, whether it rises, and its richest session. Two stretches that
follow each other make one: they rise together if both do and the second begins no lower than the first ends. So
tasks summarise the rows they hold, and only summaries are shuffled, kept in state, and merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.keys import BUCKETS

MAX_LONG = 2**63 - 1
_USAGE = f"struct<{', '.join(f'{b}: bigint' for b in BUCKETS)}>"
#: Where a stretch stands in its text: stdout before stderr, ``data:`` lines read again after all others, file by file.
PLACE = ["_rank", "_pass", "_part", "_seq"]
PLACE_SCHEMA = "_rank int, _pass int, _part string, _seq long, _next long"
SCHEMA = (
    f"turns long, first long, last {_USAGE}, sums {_USAGE}, rising boolean, score long, cache_write long, reasoning long, later int, "
    f"session {_USAGE}, turn_family boolean, session_family boolean"
)
FIELDS = ["turns", "first", "last", "sums", "rising", "score", "cache_write", "reasoning", "later", "session", "turn_family", "session_family"]
#: Rows of a text whose summaries meet in one list, before those of the whole text do.
STRETCH = 1 << 20


def total(usage: dict) -> int:
    return min(sum(usage.values()), MAX_LONG)


class Tally:
    """Summary of a stretch, in plain Python; its fields are the columns ``FIELDS``."""

    __slots__ = FIELDS

    def __init__(self, *values):
        fresh = (0, None, None, dict.fromkeys(BUCKETS, 0), True, None, None, None, None, None, False, False)
        for name, value in zip(FIELDS, values or fresh):
            setattr(self, name, value)

    def values(self) -> list:
        return [getattr(self, name) for name in FIELDS]

    def empty(self) -> bool:
        return not self.turns and self.session is None

    def add(self, kind: str, usage: dict, family: bool) -> None:
        """The next record: a turn, a ``group``, or anything else, which is a session."""
        if kind == "turn":
            self._append(Tally(1, usage["input"], usage, usage, True, None, None, None, None, None, family, False))
        else:
            self._compete(total(usage), usage["cache_write"], usage["reasoning"], 2 if kind == "group" else 1, usage)
            self.session_family |= family and kind == "session"

    def merge(self, later: Tally) -> None:
        """The stretch that follows."""
        self._append(later)
        if later.session is not None:
            self._compete(later.score, later.cache_write, later.reasoning, later.later, later.session)
        self.session_family |= later.session_family

    def _append(self, later: Tally) -> None:
        if later.turns:
            self.rising &= later.rising and (not self.turns or later.first >= self.last["input"])
            self.first = later.first if not self.turns else self.first
            self.last = later.last
            self.sums = {b: min(self.sums[b] + later.sums[b], MAX_LONG) for b in BUCKETS}
            self.turns += later.turns
        self.turn_family |= later.turn_family

    def _compete(self, score: int, cache_write: int, reasoning: int, later: int, usage: dict) -> None:
        """Of equally rich sessions the earlier stands, but sessions before groups."""
        mine = (score, cache_write, reasoning, -later)
        if self.session is None or mine > (self.score, self.cache_write, self.reasoning, -self.later):
            self.score, self.cache_write, self.reasoning, self.later, self.session = score, cache_write, reasoning, later, usage


def _rich(usage: dict | None) -> tuple:
    return (total(usage), usage["cache_write"], usage["reasoning"]) if usage and total(usage) else (0, 0, 0)


def settled(stretches: Iterable[Tally], turns: str = "auto") -> dict | None:
    """The usage of a text from its stretches in order; the columns of ``usage_of_text`` say the same."""
    whole = Tally()
    for stretch in stretches:
        whole.merge(stretch)
    last = {"auto": whole.rising, "sum": False, "last": True}[turns]
    turn = (whole.last if last else whole.sums) if whole.turns else None
    if whole.turn_family and whole.session_family:
        return turn or whole.session
    return turn if turn and _rich(turn) >= _rich(whole.session) else whole.session or turn


def chosen(usages: Iterable[tuple[str, dict]]) -> tuple[str, dict] | None:
    """The richest of an attempt's ``(source, usage)``, as ``choose_source`` has it."""
    rank = {"cli": 2, "sidecar": 1}
    counted = [(source, usage) for source, usage in usages if total(usage)]
    named = [x for x in counted if x[0] != "home"] or [("session", usage) for _, usage in counted]
    return max(named, key=lambda x: (_rich(x[1]), rank.get(x[0], 0), x[1]["input"], x[1]["output"]), default=None)


class Stretches:
    """The stretches of one file of a stream, as they come in: ``[seq, next, tally]``, in order, none overlapping.

    Neighbours merge. New rows take the place of older ones that they cover, and rows within a stretch that is held
    were counted already, so a file that is read again after it grew, or a batch that is run again, counts once. Of
    stretches that overlap otherwise, as no file that only grows gives them, the newer stands.
    """

    def __init__(self, held: str | None = None):
        self.parts = [(s, n, Tally(*v)) for s, n, v in json.loads(held)] if held else []

    def dump(self) -> str:
        return json.dumps([(s, n, t.values()) for s, n, t in self.parts])

    def take(self, rows: list[tuple[int, int, Tally]]) -> None:
        new = self._joined(sorted(rows, key=lambda r: r[:2]))
        new = [r for r in new if not any(a <= r[0] and r[1] <= b and (a, b) != r[:2] for a, b, _ in self.parts)]
        free = lambda s, n: all(n <= a or b <= s for a, b, _ in new)
        self.parts = self._joined(sorted([*new, *(p for p in self.parts if free(p[0], p[1]))], key=lambda r: r[:2]))

    @staticmethod
    def _joined(rows: list[tuple[int, int, Tally]]) -> list[tuple[int, int, Tally]]:
        out: list[tuple[int, int, Tally]] = []
        for start, end, tally in rows:
            if out and out[-1][1] == start:
                out[-1][2].merge(tally)
                out[-1] = (out[-1][0], end, out[-1][2])
            elif not out or out[-1][:2] != (start, end):  # the same rows given twice
                out.append((start, end, Tally(*tally.values())))
        return out


# ---------------------------------------------------------------------------------------------
# Tables


def saturated_sum(count: Column) -> Column:
    """The sum over rows, or the largest integer where it is larger; null without rows."""
    return F.when(F.count(count) > 0, F.coalesce(F.try_sum(count), F.lit(MAX_LONG)))


def _merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summaries of equal ``by`` as one; ``edges`` are their first and last turns, in order."""
    place, counts = F.struct(*PLACE), F.col("turns") > 0
    rank = F.struct(-F.col("score"), -F.col("cache_write"), -F.col("reasoning"), "later", *PLACE)
    best = F.min_by(F.struct("score", "cache_write", "reasoning", "later", "session"), F.when(F.col("session").isNotNull(), rank))
    edge = F.when(counts, F.struct(*PLACE, "first", F.col("last.input").alias("end")))
    out = rows.groupBy(*by).agg(
        F.sum("turns").alias("turns"), F.array_sort(F.collect_list(edge)).alias("edges"), F.max_by("last", F.when(counts, place)).alias("last"),
        F.struct(*[saturated_sum(F.col(f"sums.{b}")).alias(b) for b in BUCKETS]).alias("sums"), F.bool_and("rising").alias("rising"), best.alias("_best"),
        F.bool_or("turn_family").alias("turn_family"), F.bool_or("session_family").alias("session_family"),
        *[F.min(c).alias(c) for c in PLACE if c not in by],
    )
    higher = F.transform("edges", lambda e, i: (i == 0) | (e["first"] >= F.get("edges", i - 1)["end"]))
    rising = F.col("rising") & F.forall(higher, lambda up: up)
    return out.withColumns({"rising": rising, "first": F.get("edges", F.lit(0))["first"]}).select(
        *by, *[c for c in PLACE if c not in by], "turns", "first", "last", "sums", "rising", "_best.*", "turn_family", "session_family"
    )


def merge_tallies(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary per key, from summaries of stretches that do not overlap.

    Those of a part of a text are merged first, so that no list holds all summaries of a text of any size.
    """
    near = rows.withColumn("_near", F.floor(F.col("_seq") / STRETCH))
    return _merged(_merged(near, [*keys, *PLACE[:-1], "_near"]), list(keys))
