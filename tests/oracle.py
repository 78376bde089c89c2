"""Compare a query with its SQL in DuckDB, the way the driver does: sorted columns, rows in any order."""

from __future__ import annotations

import datetime
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings document_chunks graph_entities
graph_relationships file_states eval_items subject_areas subject_labels""".split()


def plain(value):
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if not hasattr(value, "__float__") else float(value)


def compare(spark, name: str, folder: str) -> str:
    """'' or what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    rows = con.fetchall()
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows; only ours: {sorted(a - b)[:3]}; only theirs: {sorted(b - a)[:3]}"
