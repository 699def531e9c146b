from __future__ import annotations

import pytest

from quotemill.llm import queries
from tests.sqlcheck import DATA, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables aren't here")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
