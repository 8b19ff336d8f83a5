"""The small tables as Python rows."""

import duckdb

PATH = "/root/testdata/sf0.001"


def rows(table, key="doc_id", value="text"):
    return duckdb.connect().execute(f"SELECT {key}, {value} FROM '{PATH}/{table}.parquet'").fetchall()


def key(row):
    """Sorts rows with nulls."""
    return tuple((x is None, x if x is not None else 0) for x in row)
