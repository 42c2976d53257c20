"""Compare queries with their SQL.  ``python tests/oracle.py [sf_dir] [name ...]``"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _kind(t) -> str:
    import pyarrow.types as pt

    if pt.is_integer(t):
        return "int"
    if pt.is_floating(t):
        return "float"
    if pt.is_timestamp(t):
        return f"timestamp[{t.tz}]"
    if pt.is_string(t) or pt.is_large_string(t):
        return "string"
    return str(t)


def _rows(table):
    names = sorted(table.column_names)
    rows = list(zip(*[table[n].to_pylist() for n in names])) if names else []
    return names, sorted(rows, key=repr)


def compare(got, want) -> str:
    g_names, g = _rows(got)
    w_names, w = _rows(want)
    if g_names != w_names:
        return f"columns {g_names} != {w_names}"
    kinds = [
        (n, _kind(got.schema.field(n).type), _kind(want.schema.field(n).type))
        for n in g_names
        if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)
    ]
    if kinds:
        return f"types {kinds}"
    if len(g) != len(w):
        return f"{len(g)} rows != {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ, first {g_names} {bad[0][0]} != {bad[0][1]}"
    return ""


def fetch(con, sql):
    out = con.execute(sql)
    return out.to_arrow_table() if hasattr(out, "to_arrow_table") else out.fetch_arrow_table()


def main(argv):
    from wattloom.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, folder).toArrow()
            took = time.time() - start
            if name in sqls:
                problem = compare(got, fetch(con, sqls[name]))
                state = "ok  " if not problem else "BAD "
            else:
                problem, state = "", "rows"
        except Exception as e:  # noqa: BLE001
            problem, state, took = f"{type(e).__name__}: {str(e)[:1500]}", "FAIL", time.time() - start
            got = None
        failed += state in ("BAD ", "FAIL")
        print(f"{state} {name:28s} {got.num_rows if got is not None else '-':>7} rows {took:6.2f}s {problem}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
