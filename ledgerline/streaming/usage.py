"""Usage of attempts while their streams are still growing."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ledgerline.functions.keys import BUCKETS
from ledgerline.operators.tally import FIELDS, PLACE, Stretches, Tally, chosen, settled
from ledgerline.operators.usage import ATTEMPT_KEYS, all_texts, tallies
from ledgerline.streaming.keyed import use_rocksdb

_USAGE = T.StructType([T.StructField(b, T.LongType()) for b in BUCKETS])


def _plain(value):
    return value.asDict() if isinstance(value, Row) else value


class _HarvestProcessor(StatefulProcessor):
    """Keeps the stretches of an attempt's texts, merged as far as they follow each other, and says its usage anew
    whenever some come in."""

    def __init__(self, keys: list[str], turns: str):
        self.keys, self.turns = keys, turns

    def init(self, handle):
        place = T.StructType([T.StructField("place", T.StringType())])
        self.texts = handle.getMapState("texts", place, T.StructType([T.StructField("stretches", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        new: dict[str, list] = {}
        for row in rows:
            place = json.dumps([row["source"], row["file"], *(row[c] for c in PLACE[:-1])])
            new.setdefault(place, []).append((row["_seq"], row["_next"], Tally(*(_plain(row[f]) for f in FIELDS))))
        for place, found in new.items():
            held = self.texts.getValue((place,))[0] if self.texts.containsKey((place,)) else None
            stretches = Stretches(held)
            stretches.take(found)
            self.texts.updateValue((place,), (stretches.dump(),))
        best = chosen(self._usages())
        if best is None:
            return iter(())
        usage = Row(*BUCKETS)(*(best[1][b] for b in BUCKETS))
        return iter([Row(*self.keys, "source", "usage")(*key, best[0], usage)])

    def _usages(self) -> Iterator[tuple[str, dict]]:
        """The usage of each text, from its stretches in the order of their places."""
        texts: dict[tuple, list] = {}
        for place, held in self.texts.iterator():
            source, file, *where = json.loads(place[0])
            texts.setdefault((source, file), []).append((where, Stretches(held[0]).parts))
        for (source, _), parts in texts.items():
            usage = settled((t for _, held in sorted(parts, key=lambda p: p[0]) for _, _, t in held), self.turns)
            if usage:
                yield source, usage

    def close(self):
        pass


def harvest_stream(
    lines: DataFrame, by: Sequence[str] = ATTEMPT_KEYS, sse: str = "once", turns: str = "auto", whole: bool = False
) -> DataFrame:
    """Streaming ``harvest``: ``by``, ``source`` and ``usage`` of every attempt that a micro-batch brings rows of.

    ``lines``: as for ``harvest``, with ``source`` ``sidecar`` for sidecars, in any order and any split into
    micro-batches. After all rows have come, the last row of an attempt is what ``harvest`` gives. Tasks sum up their
    rows first; the state of an attempt is a summary per stretch of lines with nothing missing, so one per file once its
    lines are there. Lines that come again, with their places, take the place of those they repeat. Run in update mode
    (``upsert_stream`` keeps the last row per attempt).
    """
    use_rocksdb(lines.sparkSession)
    by = list(by)
    rows = tallies(all_texts(lines, by=by), [*by, "source", "file"], sse, whole, every=True)
    out = T.StructType([*[lines.schema[k] for k in by], T.StructField("source", T.StringType()), T.StructField("usage", _USAGE)])
    return rows.groupBy(*by).transformWithState(
        statefulProcessor=_HarvestProcessor(by, turns), outputStructType=out, outputMode="Update", timeMode="None"
    )
