"""Physical plans are those meant: pruned scans, pushed filters, no row-at-a-time Python, no product joins."""

import re

import pytest

from quern import plans
from quern.operators import views
from quern.sources.graph import bridge, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if re.match(r"R\d|S\d|T\d|C(1|2|6|8|9|14|15|17|22)_|F\d|G(1|3|4|6|7|10|11|15|18|22)_", n)))
def test_stays_in_the_jvm_without_products(spark, name):
    text = plan(plans.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    if name not in ("F18_clean_input", "F19_leaked_parts", "T4_half_open_breaker", "T4b_breaker_states"):
        assert "InPandas" not in text and "InArrow" not in text
    if not re.search(r"^S7_|^R21", name):  # single-row aggregates side by side
        assert "BroadcastNestedLoopJoin" not in text, text


def test_scans_read_only_what_is_used(spark):
    read = {m[1]: m[2] for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?ReadSchema: struct<([^>]*)>", plan(views.unsupported_claims(bridge(spark, SF))))}
    columns = ",".join(read.values())
    assert "l_tax" not in columns and "p_retailprice" not in columns and "p_brand" not in columns and "p_name" in columns


def test_filters_reach_the_scan(spark):
    text = plan(table(spark, SF, "events").where("event_type = 'error'").groupBy("user_id").count())
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", text)
