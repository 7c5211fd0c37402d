"""Holds a query's rows against SQL on the same tables."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    ran = con.execute(sql)
    names = [c[0] for c in ran.description]
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in ran.fetchall()]
    assert sorted(names) == sorted(df.columns)
    got = [tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
