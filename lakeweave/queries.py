"""The registered queries: dialect text (or a DataFrame function) and the DuckDB SQL with the same result."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import joins, rollup, topk
from .sources import midi, prompt, sheet
from .streaming import windows

FULL = "rows between unbounded preceding and unbounded following"

#: name -> (dialect, DuckDB); None: the dialect's text is DuckDB's as well.
SQL: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "with o as (select o_orderkey, o_orderstatus from orders where o_totalprice > 1000) select l_returnflag, count(*) as n, sum(l_quantity) as qty, avg(l_quantity) as mean from lineitem join o on lineitem.l_orderkey = o.o_orderkey where l_quantity < 25 group by 1 order by 1",
        None,
    ),
    "scan_project": ("select o_orderkey, o_orderpriority, o_totalprice from orders", None),
    "star_with_literal": ("select 'sqr' as func, * from region", None),
    "qualified_star": ("select n.* from nation n join region r on n.n_regionkey = r.r_regionkey where r.r_regionkey > 1", None),
    "select_no_from": ("select 1 as a, 'x' as b, 2.5 as c, true as d, -3 as e, pi as f", "select 1::bigint as a, 'x' as b, 2.5::double as c, true as d, (-3)::bigint as e, pi() as f"),
    "default_names": ("select c_custkey, c_acctbal * 2, c_acctbal + 1 from customer", "select c_custkey, c_acctbal * 2 as col_2, c_acctbal + 1 as col_3 from customer"),
    "comments": ("-- a comment\nselect r_name /* block */ from region;", "select r_name from region"),
    "filter_and": ("select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'O'", None),
    "filter_or": ("select o_orderkey from orders where o_totalprice > 400000 or o_orderstatus = 'P'", None),
    "filter_theta": ("select p_partkey from part where p_size <= 10 and p_retailprice >= 903 and p_size != 3 and p_retailprice < 917", None),
    "filter_grouped": ("select l_orderkey, l_linenumber, l_quantity from lineitem where (l_quantity > 45 or l_discount > 0.08) and (l_tax < 0.02 or l_returnflag = 'A')", None),
    "filter_not": ("select c_custkey from customer where not c_mktsegment = 'BUILDING'", None),
    "filter_truthy": ("select p_partkey from part where p_size - 10", "select p_partkey from part where p_size - 10 <> 0"),
    "filter_truthy_string": ("select c_custkey from customer where case when c_acctbal > 0 then c_name else '' end", "select c_custkey from customer where c_acctbal > 0 and c_name <> ''"),
    "null_tests": (
        "with d as (select doc_id, case when doc_id > 50 then source else null end as s from documents) select doc_id, s is null as missing, s is not null as present, s = 'src1' as same from d",
        None,
    ),
    "null_arithmetic": ("with d as (select o_orderkey as k, case when o_totalprice > 200000 then o_totalprice else null end as p from orders) select k, p + 1 as a, -p as b from d where p is null or p > 300000", None),
    "is_boolean": ("select o_orderkey, (o_totalprice > 100000) is true as big, (o_totalprice > 100000) is not true as small from orders", None),
    "three_valued": ("with d as (select c_custkey as k, case when c_acctbal > 0 then true else null end as b from customer) select k, b and false as x, b or true as y, b and true as z from d", None),
    "arith_div": ("select l_orderkey, l_linenumber, l_quantity + 1 - 2 * 3 as a, l_extendedprice / l_quantity as unit, 7 / 2 as half from lineitem", None),
    "arith_left_assoc": ("select 10 - 3 - 2 as a, 100 / 10 / 2 as b, 2 * 3 + 4 * 5 as c, -(2 + 3) * 2 as d", "select (10 - 3 - 2)::bigint as a, (100 / 10 / 2)::double as b, (2 * 3 + 4 * 5)::bigint as c, (-(2 + 3) * 2)::bigint as d"),
    "string_concat_plus": ("select c_custkey, c_name + '/' + c_mktsegment as label from customer", "select c_custkey, c_name || '/' || c_mktsegment as label from customer"),
    "string_repeat": ("select r_regionkey, r_name * 2 as twice from region", "select r_regionkey, repeat(r_name, 2) as twice from region"),
    "mixed_equality": ("select r_regionkey, r_name = 1 as same, r_name != 1 as other from region", "select r_regionkey, false as same, true as other from region"),
    "case_when": ("select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class from part", None),
    "case_no_else": ("select p_partkey, case when p_size < 10 then p_size end as small from part", None),
    "case_mixed_types": ("select p_partkey, case when p_size < 10 then p_brand else p_partkey end as v from part", "select p_partkey, case when p_size < 10 then p_brand else p_partkey::varchar end as v from part"),
    "iff": ("select p_partkey, iff(p_size > 25, 'big', 'small') as size, iff(p_size - 1, 1, 2.5) as n from part", "select p_partkey, case when p_size > 25 then 'big' else 'small' end as size, case when p_size <> 1 then 1.0::double else 2.5::double end as n from part"),
    "cast_int": ("select l_orderkey, l_linenumber, l_extendedprice::int as price from lineitem", "select l_orderkey, l_linenumber, trunc(l_extendedprice)::bigint as price from lineitem"),
    "cast_float": ("select o_orderkey, o_orderkey::string::float as f, o_custkey::float / 4 as q from orders", "select o_orderkey, o_orderkey::double as f, o_custkey::double / 4 as q from orders"),
    "cast_string": ("select c_custkey, c_custkey::string + '-' + c_nationkey::text as s from customer", "select c_custkey, c_custkey::varchar || '-' || c_nationkey::varchar as s from customer"),
    "trig": ("select event_id, sin(value) as s, cos(value) as c from events", "select event_id, sin(value) as s, cos(value) as c from events"),
    "square_wave": ("select event_id, sqr(value) as w from events", "select event_id, case when sin(value) > 0 then 1 else -1 end::bigint as w from events"),
    "pow": ("select p_partkey, pow(p_size, 2) as p, pow(2, 10) as k from part", "select p_partkey, pow(p_size, 2)::double as p, 1024::double as k from part"),
    "join_inner": ("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where c.c_acctbal > 5000", None),
    "join_left": ("select o.o_orderkey, l.l_linenumber, l.l_quantity from orders o left join lineitem l on o.o_orderkey = l.l_orderkey", None),
    "join_right": ("select l.l_linenumber, o.o_orderkey from lineitem l right outer join orders o on o.o_orderkey = l.l_orderkey", None),
    "join_full": ("select d.doc_id, l.doc_id as labelled, l.quality from documents d full outer join labels l on d.doc_id = l.doc_id", None),
    "join_cross": ("select n_name, r_name from nation cross join region", None),
    "join_comma": ("select n_name, r_name from nation, region where n_regionkey = r_regionkey", None),
    "join_using": ("select doc_id, source, quality from documents join labels using (doc_id)", None),
    "join_using_left": ("select doc_id, quality from documents left join labels using (doc_id)", None),
    "join_natural": ("select doc_id, source, toxic from documents natural join labels", None),
    "join_theta": ("select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey", None),
    "join_chain3": ("select c.c_name, o.o_orderkey, l.l_linenumber, l.l_quantity from customer c join orders o on c.c_custkey = o.o_custkey join lineitem l on o.o_orderkey = l.l_orderkey where l.l_quantity > 45", None),
    "join_self": ("select a.s_suppkey as x, b.s_suppkey as y from supplier a join supplier b on a.s_nationkey = b.s_nationkey where a.s_suppkey < b.s_suppkey", None),
    "agg_global": ("select count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, sum(l_quantity) as s, avg(l_quantity) as m from lineitem", None),
    "agg_group": ("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as s from lineitem group by 1, 2", None),
    "agg_group_name": ("select o_orderpriority as p, count(o_orderkey) as n from orders group by o_orderpriority", None),
    "agg_group_expr": ("select p_size / 10 as bucket, count(*) as n from part group by p_size / 10", None),
    "agg_expr": ("select o_orderstatus, max(o_custkey) - min(o_custkey) + 10 as spread, -count(*) as minus from orders group by 1", None),
    "agg_case": ("select o_orderstatus, case when count(*) > 100 then 'many' else 'few' end as size from orders group by 1", None),
    "agg_empty": ("select count(*) as n, sum(p_size) as s from part where p_size > 1000", "select count(*) as n, sum(p_size)::bigint as s from part where p_size > 1000"),
    "group_distinct": ("select c_mktsegment, c_nationkey from customer group by 1, 2", None),
    "having": ("select o_custkey, count(*) as n from orders group by 1 having count(*) > 12", None),
    "count_nulls": ("with d as (select case when o_totalprice > 200000 then 1 else null end as x from orders) select count(x) as n from d", "select count(*) as n from orders"),
    "count_distinct": ("select l_returnflag, count(distinct l_suppkey) as n from lineitem group by 1", None),
    "sum_distinct": ("select sum(distinct p_size) as s, avg(distinct p_size) as a from part", "select sum(distinct p_size)::bigint as s, avg(distinct p_size) as a from part"),
    "listagg": (
        "with s as (select n_regionkey, n_name from nation order by n_regionkey, n_name) select n_regionkey, listagg(n_name) as names, list_agg(n_name, ' | ') as bars from s group by 1",
        "select n_regionkey, string_agg(n_name, ',' order by n_name) as names, string_agg(n_name, ' | ' order by n_name) as bars from nation group by 1",
    ),
    "listagg_distinct": (
        "with s as (select o_orderstatus, o_orderpriority from orders order by o_orderstatus, o_orderpriority) select o_orderstatus, listagg(distinct o_orderpriority, ';') as p from s group by 1",
        "select o_orderstatus, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as p from orders group by 1",
    ),
    "window_count": ("select n_nationkey, count(1) over () as n from nation", None),
    "window_partition": ("select c_custkey, count(1) over (partition by c_nationkey, c_mktsegment) as n from customer", None),
    "window_distinct": ("select distinct c_mktsegment, count(1) over (partition by c_mktsegment) as n from customer", None),
    "window_default_frame": ("select o_orderkey, max(o_totalprice) over (partition by o_custkey order by o_orderkey) as m from orders", f"select o_orderkey, max(o_totalprice) over (partition by o_custkey order by o_orderkey {FULL}) as m from orders"),
    "window_frames": (
        "select o_orderkey, sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between 2 preceding and current row) as trailing, sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between current row and unbounded following) as ahead, count(1) over (partition by o_orderstatus order by o_orderkey rows between 1 preceding and 1 following) as near from orders",
        "select o_orderkey, sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between 2 preceding and current row)::bigint as trailing, sum(o_custkey) over (partition by o_orderstatus order by o_orderkey rows between current row and unbounded following)::bigint as ahead, count(1) over (partition by o_orderstatus order by o_orderkey rows between 1 preceding and 1 following) as near from orders",
    ),
    "window_min_max_avg": (
        "select o_orderkey, min(o_totalprice) over (partition by o_custkey) as lo, max(o_totalprice) over (partition by o_custkey) as hi, mean(o_orderkey) over (partition by o_custkey) as m, avg(o_orderkey) over () as all_m from orders",
        "select o_orderkey, min(o_totalprice) over (partition by o_custkey) as lo, max(o_totalprice) over (partition by o_custkey) as hi, avg(o_orderkey) over (partition by o_custkey) as m, avg(o_orderkey) over () as all_m from orders",
    ),
    "window_arithmetic": ("select o_orderkey, o_orderkey - min(o_orderkey) over (partition by o_custkey) as since from orders", None),
    "window_over_group": ("select o_custkey, count(*) as n, sum(count(*)) over () as total from orders group by 1", "select o_custkey, count(*) as n, (sum(count(*)) over ())::bigint as total from orders group by 1"),
    "row_number": ("select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders", None),
    "row_number_input_order": ("select i, row_number(i) over () as rn from generate_series(500)", "select i, i + 1 as rn from generate_series(0, 499) t(i)"),
    "lag": ("select event_id, lag(value) over (partition by user_id order by event_id) as a, lag(value, 2) over (partition by user_id order by event_id) as b from events", None),
    "lead": ("select event_id, lead(value) over (partition by user_id order by event_id) as a, lead(value, 3) over (partition by user_id order by event_id) as b from events", None),
    "distinct": ("select distinct c_mktsegment, c_nationkey from customer", None),
    "order_ordinal": ("select o_orderkey, o_totalprice from orders order by 2 desc, 1", None),
    "order_hidden": ("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20", None),
    "topk": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10", None),
    "limit_zero": ("select r_name from region limit 0", None),
    "union_all_semantics": ("select r_name as n from region union select r_name as n from region", "select r_name as n from region union all select r_name as n from region"),
    "union_three": ("select n_name as n, 1 as k from nation union all select r_name, 2 from region union select c_name, 3 from customer order by 1 limit 100", "select n_name as n, 1::bigint as k from nation union all select r_name, 2 from region union all select c_name, 3 from customer order by 1 limit 100"),
    "union_mixed_types": ("select r_name as v from region union all select n_nationkey from nation", "select r_name as v from region union all select n_nationkey::varchar from nation"),
    "cte_chain": ("with a as (select o_custkey, o_totalprice from orders where o_totalprice > 100000), b as (select o_custkey, count(*) as n from a group by 1) select c.c_name, b.n from b join customer c on b.o_custkey = c.c_custkey", None),
    "cte_reuse": ("with a as (select c_nationkey as k, count(*) as n from customer group by 1) select x.k, x.n, y.n as next from a x join a y on x.k + 1 = y.k", None),
    "cte_shadows_table": ("with nation as (select r_name as n_name from region) select n_name from nation", None),
    "subquery_from": ("select t.k, t.n from (select o_custkey as k, count(*) as n from orders group by 1) as t where t.n > 10", None),
    "text_column": ("select doc_id, text from documents where text != ''", None),
    "generate_series": ("select i, i * i as sq from generate_series(1000)", "select i, i * i as sq from generate_series(0, 999) t(i)"),
    "generate_series_join": ("with s as (select i from generate_series(25)) select s.i, n.n_name from s join nation n on s.i = n.n_nationkey", "select n_nationkey::bigint as i, n_name from nation"),
    "case_insensitive_functions": ("SELECT Count(*) AS n, MAX(p_size) AS m FROM part", None),
    "demo_math": ("with t as (select i, i / 100 as x from generate_series(2000)) select x, sin(x) as s, sqr(x) as w from t order by 1", "select i / 100 as x, sin(i / 100) as s, case when sin(i / 100) > 0 then 1 else -1 end::bigint as w from generate_series(0, 1999) t(i)"),
    "nested_types": ("select vec_id, embedding, label from embeddings where label = 3", None),
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).sql(text)


def ctas_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS, then again reading the table it replaces."""
    return Engine(spark, sf_dir).sql("create table lakeweave_ctas as (select r_regionkey, r_name from region); create table lakeweave_ctas as (select r_regionkey + 1 as k, r_name from lakeweave_ctas); select * from lakeweave_ctas")


def sheet_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet.set_fetcher(lambda s, tab: [["name", "favorite_color"], ["drew", "green"], ["tiffany", "blue"], ["laika", "gray"], ["flanders", "gray"]])
    return Engine(spark, sf_dir).sql("select name, favorite_color from google_sheet('a sheet', 'Example') where favorite_color != 'blue'")


def prompt_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt.set_client(lambda p: "a, b\n1, 2\n3, 4\n")
    return Engine(spark, sf_dir).sql("select a::int as a, b from ask_gpt('two columns')")


def midi_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of three notes, written where driver and local executors see it."""
    track = bytes.fromhex("00ff510307a120" "00903c40" "6080" "3c00" "0090457f" "60804500" "00904040" "8140804000" "00ff2f00")
    path = os.path.join(tempfile.mkdtemp(prefix="lakeweave-midi-"), "a.mid")
    with open(path, "wb") as f:
        f.write(b"MThd" + (6).to_bytes(4, "big") + bytes([0, 0, 0, 1, 0, 96]) + b"MTrk" + len(track).to_bytes(4, "big") + track)
    return Engine(spark, sf_dir).sql(f"select * from midi('file://{path}')")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "ctas_roundtrip": (ctas_roundtrip, "select r_regionkey::bigint + 1 as k, r_name from region"),
    "sheet_stub": (sheet_stub, "select * from (values ('drew', 'green'), ('laika', 'gray'), ('flanders', 'gray')) t(name, favorite_color)"),
    "prompt_stub": (prompt_stub, "select * from (values (1::bigint, '2'), (3::bigint, '4')) t(a, b)"),
    "midi_stub": (
        midi_stub,
        "select * from (values (0.0::double, 'C', 5::int, 523.25::double, 0.5::double, 0.5::double, 0::int), (0.5, 'A', 5, 440.0, 0.5, 0.9921875, 0), (1.0, 'E', 5, 659.25, 1.0, 0.5, 0)) t(time, note, octave, freq, length, amplitude, track)",
    ),
    "op_topk_per_group": (
        lambda s, d: topk.top_per_group(_read(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice"),
        "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3",
    ),
    "op_skewed_join": (
        lambda s, d: joins.salted_join(_read(s, d, "lineitem"), _read(s, d, "orders").select("o_orderkey", "o_orderstatus"), "l_orderkey", "o_orderkey", 4).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
        "select o_orderstatus, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1",
    ),
    "op_running_total": (
        lambda s, d: rollup.running_total(_read(s, d, "orders"), "o_orderkey", "o_custkey", "total").select("o_orderkey", "total"),
        "select o_orderkey, (sum(o_custkey) over (order by o_orderkey rows between unbounded preceding and current row))::bigint as total from orders",
    ),
    "op_tumbling_window": (
        lambda s, d: windows.tumbling(_read(s, d, "events"), "ts", "1 hour", ["event_type"]).select("start", "event_type", "n"),
        "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sql(v[0]) for k, v in SQL.items()} | {k: v[0] for k, v in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: (v[1] or v[0]).rstrip("; ") for k, v in SQL.items()} | {k: v[1] for k, v in FRAMES.items() if v[1]}
