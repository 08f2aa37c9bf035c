"""Cases worked out by hand, through the functions and the SQL of the queries over derived relations."""

from __future__ import annotations

import duckdb
import pytest

from inkflow.plans import manuscripts, relational
from inkflow.plans import sqltext as S
from tests.test_catalogue import canon


def compare(df, sql):
    got = duckdb.connect().execute(sql)
    names = [x[0] for x in got.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in got.fetchall())


@pytest.mark.parametrize("k", range(len(relational.CASES)))
def test_functions(spark, k):
    fn, data, schema, sql = relational.CASES[k]
    compare(fn(spark.createDataFrame(data, schema)), sql)


def test_blocks(spark):
    columns = ", ".join(x.split()[0] for x in manuscripts.BLOCK_COLUMNS.split(", "))
    df = manuscripts.block_mapping(spark.createDataFrame(manuscripts.BLOCKS, manuscripts.BLOCK_COLUMNS))
    compare(df, "WITH " + S.values("blocks", columns, manuscripts.BLOCKS) + "," + manuscripts._FROM_BLOCKS + " SELECT * FROM mapped")
