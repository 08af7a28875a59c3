"""Every query of the package that has a SQL statement, against DuckDB."""

import pytest

from attesta.llm import queries
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cols, got = oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(queries.SQL[name])
    want_cols, want = oracle.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols
    assert got and got == want
