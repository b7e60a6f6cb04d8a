"""Runs registered queries next to their SQL and compares whole results."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty where the Spark result equals the SQL result."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    actual = [tuple(r) for r in df.collect()]
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(actual) != len(expected):
        out.append(f"{len(actual)} rows != {len(expected)}")
    a, b = canonical(df.columns, actual), canonical(names, expected)
    if a != b:
        in_a, in_b = set(a), set(b)
        extra, missing = [x for x in a if x not in in_b][:2], [x for x in b if x not in in_a][:2]
        out.append(f"columns {sorted(names)}\n  spark only {extra}\n  sql only   {missing}")
    return out
