"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from photonloom.plans.oracles import SQL
from photonloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({SQL[name]})")
    assert [TYPES[str(t)] for t in want.types] == [t for _, t in df.dtypes]
    rows = lambda x: sorted(tuple(map(shown, r)) for r in x)
    assert rows(df.collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
