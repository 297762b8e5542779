"""Compare registered queries with their SQL in DuckDB, ignoring row and column order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def difference(spark, plan, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short account of the first disagreement."""
    df = plan(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    rows = cur.fetchall()
    place = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in place) for r in rows), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(b) for b in w]:
            return f"columns {cols}\n got  {g}\n want {w}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from tests.conftest import local_session

    session = local_session()
    wanted, folder = sys.argv[2:], sys.argv[1]
    oracles = contract.oracle_sql()
    for key, query in contract.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        start = time.time()
        try:
            if key in oracles:
                verdict = difference(session, query, oracles[key], folder) or "ok"
            else:
                verdict = f"no sql, {query(session, folder).count()} rows"
        except Exception as error:  # report and go on with the other queries
            verdict = f"FAILED {type(error).__name__} {str(error)[:1500]}"
        print(f"{key:34s} {time.time() - start:6.2f}s  {verdict}", flush=True)
