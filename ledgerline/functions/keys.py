"""What a JSON key or record says, judged by its spelling."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import fixed_values as V

BUCKETS = ["input", "output", "reasoning", "cache_hit", "cache_write"]


def fold_key(name: str) -> str:
    """SQL for a key in lower-case ASCII letters and digits only: ``cacheRead_tokens`` is ``CacheReadTokens``."""
    return f"regexp_replace(lower({name}), '[^a-z0-9]+', '')"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _among(text: str, words) -> str:
    return f"{text} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def classify_folded(key: str, parent: str) -> str:
    """SQL for the bucket of a folded key under a folded parent key, or null."""
    totals = f"(contains({key}, 'total') AND NOT {_any(key, [*V.INPUT_WORDS, 'output'])})"
    cached = f"(startswith({parent}, 'cache') OR contains({key}, 'cache'))"
    counted = _any(key, V.COUNT_WORDS)
    is_input = f"{_among(key, V.INPUT_KEYS)} OR startswith({key}, 'input') OR ({_any(key, V.INPUT_WORDS)} AND {counted})"
    is_output = f"{_among(key, V.OUTPUT_KEYS)} OR startswith({key}, 'output') OR ({_any(key, V.OUTPUT_WORDS)} AND {counted})"
    return f"""CASE
        WHEN {key} = '' OR {_among(key, V.NOT_COUNTS)} THEN NULL
        WHEN endswith({key}, 'id') OR endswith({key}, 'ms') OR {totals} THEN NULL
        WHEN contains({key}, 'ephemeral') THEN 'cache_write'
        WHEN {cached} AND {_any(key, V.CACHE_WRITE_WORDS)} THEN 'cache_write'
        WHEN {cached} THEN 'cache_hit'
        WHEN {_any(key, V.REASONING_WORDS)} THEN 'reasoning'
        WHEN {is_input} THEN 'input'
        WHEN {is_output} THEN 'output' END"""


def classify_key(name: str, parent: str = "''") -> Column:
    """Bucket of a key as spelled; both arguments are columns or SQL.

    The folded forms are bound once, since the rules look at them many times.
    """
    folded = f"named_struct('k', {fold_key(f"coalesce({name}, '')")}, 'p', {fold_key(f"coalesce({parent}, '')")})"
    return F.expr(f"transform(array({folded}), f -> {classify_folded('f.k', 'f.p')})[0]")


_BUCKETS_SEEN: dict[tuple[str, str], str | None] = {}


def folded(name: str) -> str:
    """``fold_key`` for one key inside a Python worker."""
    return re.sub("[^a-z0-9]+", "", name.lower())


def bucket_of(name: str, parent: str) -> str | None:
    """``classify_key`` for one key inside a Python worker. Logs repeat a few keys, so the answers are kept."""
    seen = (name, parent)
    if seen not in _BUCKETS_SEEN:
        if len(_BUCKETS_SEEN) >= 100_000:
            _BUCKETS_SEEN.clear()
        _BUCKETS_SEEN[seen] = _spelled(folded(name), folded(parent))
    return _BUCKETS_SEEN[seen]


def _spelled(key: str, parent: str) -> str | None:
    holds = lambda words: any(word in key for word in words)
    if not key or key in V.NOT_COUNTS or key.endswith(("id", "ms")):
        return None
    if "total" in key and not holds([*V.INPUT_WORDS, "output"]):
        return None
    cached = parent.startswith("cache") or "cache" in key
    rules = [
        ("cache_write", "ephemeral" in key or cached and holds(V.CACHE_WRITE_WORDS)),
        ("cache_hit", cached),
        ("reasoning", holds(V.REASONING_WORDS)),
        ("input", key in V.INPUT_KEYS or key.startswith("input") or holds(V.INPUT_WORDS) and holds(V.COUNT_WORDS)),
        ("output", key in V.OUTPUT_KEYS or key.startswith("output") or holds(V.OUTPUT_WORDS) and holds(V.COUNT_WORDS)),
    ]
    return next((bucket for bucket, fits in rules if fits), None)


def record_kind(raw_type: Column, scope: Column) -> Column:
    """``session``, ``turn`` or ``unknown``. The scope decides before the type."""
    scope = F.lower(scope)
    return (
        F.when(scope.isin(V.SESSION_SCOPES), "session")
        .when(scope.isin(V.TURN_SCOPES), "turn")
        .when(raw_type.isin(V.SESSION_TYPES), "session")
        .when(raw_type.isin(V.TURN_TYPES), "turn")
        .when(F.endswith(raw_type, F.lit("session")) | F.endswith(raw_type, F.lit("total")), "session")
        .otherwise("unknown")
    )


def kind_from(raw_type: str | None, scope: str | None) -> str:
    """``record_kind`` of plain values."""
    scope, raw_type = (scope or "").lower(), raw_type or ""
    if scope in V.SESSION_SCOPES or scope in V.TURN_SCOPES:
        return "session" if scope in V.SESSION_SCOPES else "turn"
    if raw_type in V.SESSION_TYPES or raw_type in V.TURN_TYPES:
        return "session" if raw_type in V.SESSION_TYPES else "turn"
    return "session" if raw_type.endswith(("session", "total")) else "unknown"
