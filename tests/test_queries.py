"""Every registered query runs; those with an oracle give its rows."""

from __future__ import annotations

import pytest

from ledgerbars import registry
from tests.compare import connect, spark_rows, sql_rows

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    got = spark_rows(registry.queries()[name](spark, sf))
    if name in registry.oracle_sql():
        assert got == sql_rows(connect(sf), registry.oracle_sql()[name])
    else:
        assert got[1] or name.startswith("stream_")


def test_entry_points(spark):
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(NAMES) <= set(q)
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_no_cross_join_and_pushed_filters(spark, sf):
    plan = lambda n: registry.queries()[n](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "CartesianProduct" not in plan("mae_mfe_holding") and "BroadcastNestedLoopJoin" not in plan("asof_last_view_before_purchase")
    scan = plan("range_scan")
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in scan and "l_extendedprice" not in scan
