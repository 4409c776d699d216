"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    found = con.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == columns
    theirs = sorted(found.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall(), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-8), (a, b)


def test_others_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DATA).count() >= 0
