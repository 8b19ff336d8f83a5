"""Run registered queries next to their SQL twins and compare every value.

Usage: python tests/oracle.py [sf dir] [name or prefix ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def plain(v):
    """Comparable text of a value; ints and floats stay different kinds."""
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted("|".join(plain(v) for v in r) for r in zip(*cols))


def kinds(arrow):
    return {f.name: str(f.type).replace("large_", "") for f in arrow.schema}


def compare(spark, con, fn, sql, path):
    got = fn(spark, path).toArrow()
    names, mine = rows_of(got)
    if sql is None:
        return f"rows only ({len(mine)})"
    want = con.execute(sql).to_arrow_table()
    names2, theirs = rows_of(want)
    if names != names2:
        return f"FAIL columns {names} vs {names2}"
    a, b = kinds(got), kinds(want)
    diff = {n: (a[n], b[n]) for n in names if a[n] != b[n]}
    note = f" types {diff}" if diff else ""
    if len(mine) != len(theirs):
        extra = [x for x in mine if x not in set(theirs)][:2]
        miss = [x for x in theirs if x not in set(mine)][:2]
        return f"FAIL rows {len(mine)} vs {len(theirs)} extra {extra} missing {miss}{note}"
    bad = [(x, y) for x, y in zip(mine, theirs) if x != y]
    if bad:
        return f"FAIL {len(bad)} of {len(mine)} values {names} {bad[:2]}{note}"
    return ("FAIL" if note else "ok") + f" {len(mine)} rows{note}"


def main():
    from groveflow.plans import QUERIES, SQL
    from groveflow.session import local_session

    args = sys.argv[1:]
    path = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    failed = []
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            with connect(path) as con:  # a fatal error of the engine ends with its query
                result = compare(spark, con, QUERIES[name], SQL.get(name), path)
        except Exception as e:  # report and go on
            result = "FAIL " + type(e).__name__ + " " + str(e)[:700]
        if result.startswith("FAIL"):
            failed.append(name)
        print(f"{name}: {result} [{time.time() - start:.1f}s]"[:1500], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
