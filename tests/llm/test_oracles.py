"""The results that SQL can express against their definitions on the smallest tables."""

import pytest

from scrivan.llm import queries
from tests.compare import connection, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = connection(FOLDER).sql(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
