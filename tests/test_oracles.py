"""Every query of the engine over the smallest tables against its SQL."""

import duckdb
import pytest

from tarnmill.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    sql = c.sql(ORACLES[name])
    assert sorted(sql.columns) == names
    place = [sql.columns.index(x) for x in names]
    assert sorted(repr(tuple(r[x] for x in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
