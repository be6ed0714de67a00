"""The queries of corpus operators that have SQL against it."""

import duckdb
import pytest

from tarnmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    sql = c.sql(ORACLES[name])
    assert sorted(sql.columns) == names
    place = [sql.columns.index(x) for x in names]
    assert sorted(repr(tuple(r[x] for x in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in sql.fetchall())


def test_linked_parts_in_sql(spark, tmp_path):
    """The tables have no parts that complement each other: texts that have."""
    token = "aB3dE5gH7jK9mN1pQ3sT"
    texts = [None, "", f"user: bob42 {token} https://x.y/z?q=1", f"{token} alone 🙂 é", "token: yes", "sha " + "0a" * 16 + " see https://x.y/z", "AKIA" + "A" * 16 + f" é {token}", "user=" + "0a" * 16, f'host = "a.b" secret: abcdef {"x " * 90} login: joe {token}', f"{token.lower()} https://a password:{token}"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["op1_secrets"](spark, str(tmp_path))
    want = {r[0]: r[1:] for r in c.sql(f"select doc_id, {', '.join(df.columns[1:])} from ({ORACLES['op1_secrets']})").fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in df.collect()}
    assert got == want and sum(r.n_linked for r in df.collect()) > 5
