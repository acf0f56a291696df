"""Compares a query with its SQL on DuckDB, as multisets of rows with columns sorted by name."""

from collections import Counter
from pathlib import Path

import duckdb


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return Counter(tuple(repr(v[i]) for i in order) for v in values)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    with duckdb.connect() as c:
        for p in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = c.execute(sql)
        names = [d[0] for d in got.description]
        theirs = rows(names, got.fetchall())
    assert sorted(map(str.lower, df.columns)) == sorted(map(str.lower, names))
    assert sum(ours.values()) == sum(theirs.values())
    assert ours == theirs, (list((ours - theirs).items())[:5], list((theirs - ours).items())[:5])
