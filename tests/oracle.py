"""Runs a query and its SQL side by side."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in values)


def assert_same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "events", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = query(spark, sf), con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
