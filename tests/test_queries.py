"""Every registered query with comparison SQL, on the smallest tables."""

import pytest

from oracle import connect, differences
from throngcast.plans import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, engine, name):
    query = QUERIES[name]
    assert differences(query.run(spark, FOLDER), engine, query.sql) is None
