import pytest
from oracle import compare

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE[name]) is None
