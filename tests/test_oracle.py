import pytest
from oracle import compare

from quern import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_oracle(spark, name):
    assert compare(spark, SF, plans.QUERIES[name], plans.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_oracle_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
