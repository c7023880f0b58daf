"""Run a registered plan and its SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "as_tuple"):  # Decimal
        return repr(float(value))
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, sf: str, build, sql: str | None):
    """Returns (row count, problem); the problem is None when the results agree."""
    df = build(spark, sf)
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    if sql is None:
        return len(got), None
    con = connect(sf)
    relation = con.sql(sql)
    names, rows = relation.columns, relation.fetchall()
    con.close()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}"
    want = _rows(names, rows)
    if len(got) != len(want):
        return len(got), f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"{sorted(names)}: {a} against {b}"
    return len(got), None


def main(argv):
    import time

    import __spark_entry__ as entry
    from effectlab.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    sql = entry.oracle_sql()
    bad = []
    for name, build in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            count, problem = compare(spark, sf, build, sql.get(name))
        except Exception as error:  # report and go on with the next plan
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "FAIL" if problem else ("ok  " if name in sql else "rows")
        print(f"{mark} {name} rows={count} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    main(sys.argv[1:])
