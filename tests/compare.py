"""Order-insensitive comparison of a Spark result with SQL run on DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    """(spark names, oracle names, rows only in Spark, rows only in SQL)"""
    got = normal_rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = normal_rows(names, cursor.fetchall())
    if got == want:
        return sorted(df.columns), sorted(names), [], []
    from collections import Counter

    a, b = Counter(got), Counter(want)
    return sorted(df.columns), sorted(names), list((a - b).elements()), list((b - a).elements())
