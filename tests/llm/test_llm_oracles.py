import pytest
from oracle import assert_same

from quillspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])
