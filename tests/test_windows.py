"""Windows dealt by range: against DuckDB on partitions that go over many ranges or share one, and how rows lie in tasks."""

import random

import pandas as pd
import pytest

from conftest import SF, rows
from lakeweave import Engine

CALLS = {
    "running": "sum(v) over (partition by p order by k rows between unbounded preceding and current row)",
    "behind": "sum(v) over (partition by p order by k rows between unbounded preceding and 3 preceding)",
    "ahead of": "max(v) over (partition by p order by k rows between unbounded preceding and 2 following)",
    "rest": "min(f) over (partition by p order by k rows between current row and unbounded following)",
    "rest from": "count(v) over (partition by p order by k rows between 2 following and unbounded following)",
    "rest with": "avg(v) over (partition by p order by k rows between 4 preceding and unbounded following)",
    "down": "avg(f) over (partition by p order by k desc rows between unbounded preceding and 1 preceding)",
    "near": "sum(v) over (partition by p order by k rows between 7 preceding and 5 following)",
    "before": "count(1) over (partition by p order by k rows between 3 preceding and 2 preceding)",
    "after": "max(s) over (partition by p order by k desc rows between 1 following and 3 following)",
    "wide": "sum(v) over (partition by p order by k rows between 150 preceding and 40 following)",
    "whole": "sum(v) over (partition by p rows between unbounded preceding and unbounded following)",
    "number": "row_number() over (partition by p order by k desc)",
    "lag": "lag(s, 3) over (partition by p order by k)",
    "lead": "lead(v, 2) over (partition by p, q order by k)",
    "two keys": "count(1) over (partition by p order by q desc, k rows between unbounded preceding and current row)",
    "unpartitioned": "sum(v) over (order by k rows between unbounded preceding and current row)",
    "unpartitioned number": "row_number() over (order by k desc)",
    "unpartitioned lead": "lead(k, 2) over (order by k)",
}


@pytest.fixture(scope="module")
def tables(spark, duck):
    """p: one partition of most rows, some of a few rows or one, and null; k: unique."""
    pick = random.Random(5)
    made = []
    for k in pick.sample(range(-2000, 2000), 400):
        p = pick.choice(["a"] * 12 + ["b", "b", "c", None, f"z{pick.randrange(60)}"])
        made.append((k, p, pick.choice([None, 0, 1, 2]), pick.choice([None, pick.randrange(-50, 50)]), pick.random() * 100 - 50, pick.choice([None, "x", "yy", "é"])))
    pdf = pd.DataFrame(made, columns=["k", "p", "q", "v", "f", "s"]).astype({"k": "int64", "q": "Int64", "v": "Int64"})
    frame = spark.createDataFrame(made, "k bigint, p string, q bigint, v bigint, f double, s string").repartition(3)
    duck.register("dealt_rows", pdf)
    duck.sql("set default_null_order = 'nulls_first_on_asc_last_on_desc'")
    yield frame
    duck.sql("reset default_null_order")


@pytest.mark.parametrize("ranges", [4, 37])
def test_frames_over_ranges(spark, duck, tables, ranges):
    engine = Engine(spark)
    engine.catalog.add("dealt_rows", tables)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    items = list(CALLS.values())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = engine.sql("select k, " + ", ".join(f"{c} as c{n}" for n, c in enumerate(items)) + " from dealt_rows").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    # COUNT(x) counts rows.
    want = duck.sql("select k, " + ", ".join(f"{c.replace('count(v)', 'count(1)')} as c{n}" for n, c in enumerate(items)) + " from dealt_rows").df()
    for n, name in enumerate(CALLS):
        assert rows(got[["k", f"c{n}"]]) == rows(want[["k", f"c{n}"]]), name


def test_ties_and_equal_rows_take_a_place_each(spark):
    text = "with d as (select 1 as k from generate_series(500)) select row_number() over (partition by k order by k) as r, count(1) over (partition by k order by k rows between unbounded preceding and current row) as n, count(1) over (partition by k order by k rows between 1 preceding and 1 following) as m from d"
    got = Engine(spark).sql(text).toPandas()
    assert sorted(got.r) == sorted(got.n) == list(range(1, 501))
    assert (got.m == 2).sum() == 2 and (got.m == 3).sum() == 498


@pytest.mark.parametrize(
    "window",
    [
        "sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between 2 preceding and current row)",
        "sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between current row and unbounded following)",
        "count(1) over (partition by o_orderstatus)",
        "lag(o_custkey) over (partition by o_orderstatus order by o_orderkey)",
        "row_number() over (order by o_orderkey)",
        "row_number() over (partition by o_orderstatus order by o_orderstatus)",
    ],
)
def test_large_partitions_go_to_many_tasks(spark, window):
    """Of one status, no task of four has more than half of the rows, ties or not."""
    frame = Engine(spark, SF).sql(f"with o as (select o_orderkey, o_custkey, 'O' as o_orderstatus from orders) select {window} as w from o")
    per_task = frame.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(per_task) == 1500 and max(per_task) < 750


def test_means_of_decimals_stay_decimals(spark):
    engine = Engine(spark)
    engine.catalog.add("d", spark.sql("select id as k, cast(id as decimal(5, 1)) as x from range(5)"))
    frame = engine.sql("select k, avg(x) over (order by k rows between unbounded preceding and current row) as a, sum(x) over (order by k rows between unbounded preceding and current row) as s from d")
    assert dict(frame.dtypes) == {"k": "bigint", "a": "decimal(9,5)", "s": "decimal(15,1)"}
    assert [(float(r.a), float(r.s)) for r in frame.orderBy("k").collect()] == [(0.0, 0.0), (0.5, 1.0), (1.0, 3.0), (1.5, 6.0), (2.0, 10.0)]
