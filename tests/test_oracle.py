"""Every registered query against its SQL statement on DuckDB."""

import pytest

from tests import oracle

NAMES = sorted(oracle.registry.QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, name, sf).startswith(("ok", "rows-only"))


def test_every_query_has_sql():
    assert set(oracle.registry.SQL) == set(NAMES)
