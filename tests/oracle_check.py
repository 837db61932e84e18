"""Run registered queries against DuckDB: python tests/oracle_check.py [sf] [name parts...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rows_of(records, columns):
    """Rows with columns in name order, as sortable tuples."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v
    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=repr)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    ours = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}", len(ours)
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} / {b}", len(ours)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {d[0]: str(d[1]) for d in cursor.description}
    for name in types:
        if duck[name] in ("HUGEINT",) or duck[name].startswith("DECIMAL"):
            return f"type {name}: {types[name]} / {duck[name]}", len(ours)
    return None, len(ours)


def main():
    from quillgraph.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = []
    for name, build in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            if name in sql:
                why, n = compare(build(spark, folder), con, sql[name])
            else:
                df = build(spark, folder)
                why, n = None, len(df.collect())
        except Exception as error:  # reported per query
            why, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        spark.catalog.clearCache()
        print(f"{'ok ' if why is None else 'BAD'} {name:34s} {n:8d} rows {time.time()-start:6.1f}s "
              f"{'' if name in sql else '(rows only) '}{why or ''}", flush=True)
        if why:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
