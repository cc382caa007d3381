"""Rows of a query and of its SQL, brought to one form."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "" if math.isnan(value) else f"{value:.9g}"
    return "" if value is None else f"{float(value):.9g}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, connection, sql):
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = connection.sql(sql)
    assert found == rows_of(got.columns, got.fetchall())
