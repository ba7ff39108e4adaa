"""Compare a DataFrame with DuckDB SQL over the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of(sql, sf_dir)
    order = sorted(names)
    assert sorted(df.columns) == order
    at = [names.index(n) for n in order]
    got = sorted(repr(tuple(r[n] for n in order)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want)
