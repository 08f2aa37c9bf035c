"""Every catalogue query against its DuckDB oracle at the smallest scale."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from inkflow import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, con):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
