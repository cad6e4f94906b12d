"""Every registered core query against its DuckDB SQL."""

import pytest

from conftest import SF, rows
from lakeweave import queries as core

ORACLE = core.oracle_sql()


@pytest.mark.parametrize("name", core.queries())
def test_query(spark, duck, name):
    got = core.queries()[name](spark, SF).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(duck.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3


def test_pushdown_and_pruning(spark):
    from lakeweave import Engine

    plan = Engine(spark, SF).explain("select o_orderkey from orders where o_totalprice > 1000")["plan"]
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_ordered_frames_of_all_rows_leave_no_single_task(spark):
    from lakeweave import Engine

    engine = Engine(spark, SF)
    text = "select o_orderkey, sum(o_custkey) over (order by o_orderkey) as s, max(o_custkey) over (order by o_orderkey rows between unbounded preceding and unbounded following) as m, count(1) over (rows between unbounded preceding and unbounded following) as n from orders"
    assert "Window [" not in engine.explain(text)["plan"]
    got = engine.sql(text).selectExpr("count(*)", "min(s)", "max(s)", "min(m)", "max(m)", "min(n)", "max(n)").first()
    want = engine.sql("select count(*) as n, sum(o_custkey) as s, max(o_custkey) as m from orders").first()
    assert tuple(got) == (want.n, want.s, want.s, want.m, want.m, want.n, want.n)
