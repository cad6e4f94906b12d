"""The dialect's behaviour, case by case: text and rows. Order counts only where the text orders."""

import pytest

from lakeweave import Engine, QueryError

USERS = "with users as (select 1 as id, 'drew' as name union all select 2, 'alice' union all select 3, 'bob'), events as (select 1 as id, 'drove' as event union all select 2, 'walked' union all select 1, 'flew') "
PEOPLE = "with data as (select 1 as id, 'alice' as name union all select 2, 'bob' union all select 3, 'alice' union all select 4, 'bob' union all select 5, 'alice') "
NULLS = "with d as (select 1 as k, 1 as v union all select 2, null union all select 3, 3) "

CASES = {
    "literals": ("select 1 as i, 'a' as s, 2.5 as f, true as b, null as n, -4 as m, 1e3 as e", [(1, "a", 2.5, True, None, -4, 1000.0)]),
    "pi": ("select cos(pi) as c, PI as p", [(-1.0, 3.141592653589793)]),
    "names": ("select 1, 2 as b, 3", ["col_1", "b", "col_3"]),
    "comments": ("select 1 as a -- one\n, /* two\n lines */ 2 as b;", [(1, 2)]),
    "left associative": ("select 10 - 3 - 2 as a, 16 / 4 / 2 as b", [(5, 2.0)]),
    "precedence": ("select 1 + 2 * 3 = 7 and 2 < 3 or false as a, (1 + 2) * 3 as b", [(True, 9)]),
    "comparison levels": ("select 1 = 2 < 3 as a, true = 2 < 3 as b", [(True, True)]),
    "division": ("select 7 / 2 as a, 6 / 3 as b", [(3.5, 2.0)]),
    "string plus": ("select 'a' + 'b' + 'c' as s, 'a' + null as n", [("abc", None)]),
    "casts": ("select '12'::int as a, 2.9::int as b, -2.9::int as c, 3::float as d, 4::string as e, '5'::int::string as f", [(12, 2, -2, 3.0, "4", "5")]),
    "is": ("select null is null as a, 1 is not null as b, true is true as c, null is true as d, 1 is 1 as e", [(True, True, True, False, True)]),
    "three valued": ("select null and false as a, null or true as b, null = 1 as c, not true as d", [(False, True, None, False)]),
    "no coercion": ("select 'a' = 1 as a, 'a' != 1 as b", [(False, True)]),
    "functions": ("select sin(0) as a, sqr(1) as b, sqr(4) as c, pow(2, 3) as d, iff(1 < 2, 'y', 'n') as e, iff(0, 1, 2) as f", [(0.0, 1, -1, 8.0, "y", 2)]),
    "case": ("select i, case when i = 0 then 'zero' when i = 1 then 'one' else 'many' end as n from generate_series(3) order by i", [(0, "zero"), (1, "one"), (2, "many")]),
    "case without else": ("select case when false then 1 end as n", [(None,)]),
    "series": ("select i from generate_series(4, 0.01) order by i", [(0,), (1,), (2,), (3,)]),
    "series alias": ("select g.i from generate_series(1 + 1) as g order by 1 desc", [(1,), (0,)]),
    "where": ("select i from generate_series(10) where i > 2 and i < 5 or i = 9 order by i", [(3,), (4,), (9,)]),
    "where truthy": ("select i from generate_series(3) where i order by i", [(1,), (2,)]),
    "where null drops": (NULLS + "select k from d where v > 0 order by k", [(1,), (3,)]),
    "inner join": (USERS + "select users.name, events.event from users join events on users.id = events.id order by name, event", [("alice", "walked"), ("drew", "drove"), ("drew", "flew")]),
    "left join": (USERS + "select u.name, e.event from users u left outer join events as e on u.id = e.id order by name, event", [("alice", "walked"), ("bob", None), ("drew", "drove"), ("drew", "flew")]),
    "right join": (USERS + "select users.name, events.event from users right outer join events on users.id = events.id order by name, event", [("alice", "walked"), ("drew", "drove"), ("drew", "flew")]),
    "full join": (USERS + "select users.name, e.id from users full outer join (select 9 as id) e on users.id = e.id order by 2, 1", [("alice", None), ("bob", None), ("drew", None), (None, 9)]),
    "cross join": (USERS + "select users.id as a, events.id as b from users cross join events where users.id = 3 order by 2", [(3, 1), (3, 1), (3, 2)]),
    "comma join": (USERS + "select users.name from users, events where users.id = events.id and event = 'flew'", [("drew",)]),
    "using": (USERS + "select * from users join events using (id) order by 1, 3", [(1, "drew", "drove"), (1, "drew", "flew"), (2, "alice", "walked")]),
    "using qualified": (USERS + "select users.id as a, events.id as b from users left join events using (id) where name = 'bob'", [(3, None)]),
    "natural": (USERS + "select name, event from users natural join events order by 2", [("drew", "drove"), ("drew", "flew"), ("alice", "walked")]),
    "theta join": ("with a as (select i from generate_series(3)), b as (select i from generate_series(3)) select a.i as x, b.i as y from a join b on a.i < b.i order by 1, 2", [(0, 1), (0, 2), (1, 2)]),
    "chained joins": (USERS + "select u.name, e.event, v.name as other from users u join events e on u.id = e.id join users v on v.id = u.id + 1 order by 2", [("drew", "drove", "alice"), ("drew", "flew", "alice"), ("alice", "walked", "bob")]),
    "aggregates": ("with d as (select 1 as id union select 2 union select 2 union select 3) select min(id) as a, max(id) as b, sum(id) as c, avg(id) as d, count(id) as e, count(distinct id) as f, count(*) as g from d", [(1, 3, 8, 2.0, 4, 3, 4)]),
    "aggregates of nulls": (NULLS + "select count(v) as a, sum(v) as b, avg(v) as c, count(*) as d from d", [(3, 4, 2.0, 3)]),
    "empty aggregate": ("select count(*) as n, sum(i) as s from generate_series(3) where i > 9", [(0, None)]),
    "group ordinal": (PEOPLE + "select name, count(*) as n from data group by 1 order by 1", [("alice", 3), ("bob", 2)]),
    "group by name and expression": (PEOPLE + "select id > 2 as late, sum(id) + 10 as s from data group by late order by 2", [(False, 13), (True, 22)]),
    "group without aggregate": (PEOPLE + "select name from data group by 1 order by 1", [("alice",), ("bob",)]),
    "aggregate expressions": (PEOPLE + "select name, -sum(id) as a, pow(count(*), 2) as b, case when max(id) > 4 then 'x' else 'y' end as c from data group by 1 order by 1", [("alice", -9, 9.0, "x"), ("bob", -6, 4.0, "y")]),
    "having": (PEOPLE + "select name from data group by 1 having count(*) > 2", [("alice",)]),
    "listagg": ("select listagg(i) as a, list_agg(i, '|') as b from generate_series(4)", [("0,1,2,3", "0|1|2|3")]),
    "listagg distinct": (PEOPLE + "select listagg(distinct name) as a from data", [("alice,bob",)]),
    "window all": ("select count(1) over () as n from generate_series(3)", [(3,), (3,), (3,)]),
    "window partition": (PEOPLE + "select distinct name, count(1) over (partition by name) as n from data order by 1", [("alice", 3), ("bob", 2)]),
    "window default frame": ("select i, sum(i) over (order by i) as s from generate_series(3) order by i", [(0, 3), (1, 3), (2, 3)]),
    "window frame": ("select i, sum(1) over (order by i rows between 1 preceding and current row) as a, sum(1) over (order by i rows between current row and unbounded following) as b from generate_series(3) order by i", [(0, 1, 3), (1, 2, 2), (2, 2, 1)]),
    "window unordered": ("select i, row_number(i) over () as r, lag(i, 1) over () as a, lead(i, 2) over () as b from generate_series(3) order by i", [(0, 1, None, 2), (1, 2, 0, None), (2, 3, 1, None)]),
    "row number": (PEOPLE + "select id, row_number() over (partition by name order by id desc) as r from data order by id", [(1, 3), (2, 2), (3, 2), (4, 1), (5, 1)]),
    "window in expression": ("select i - avg(i) over () as d from generate_series(3) order by 1", [(-1.0,), (0.0,), (1.0,)]),
    "sort": ("select i, -i as j from generate_series(3) order by j", [(2, -2), (1, -1), (0, 0)]),
    "sort by hidden column": (PEOPLE + "select name from data order by id desc limit 2", [("alice",), ("bob",)]),
    "nulls sort first": (NULLS + "select v from d order by v", [(None,), (1,), (3,)]),
    "limit": ("select i from generate_series(9) order by i desc limit 2", [(8,), (7,)]),
    "limit zero": ("select i from generate_series(9) limit 0", []),
    "distinct": ("with d as (select 2 as id union select 2 union select 3) select distinct id from d order by id", [(2,), (3,)]),
    "union keeps copies": ("select 1 as a union select 1 union all select 1", [(1,), (1,), (1,)]),
    "union of types": ("select 1 as a union all select 'x' order by 1", [("1",), ("x",)]),
    "union widens": ("select 1 as a union all select 2.5 order by 1", [(1.0,), (2.5,)]),
    "cte chain": ("with a as (select i from generate_series(5)), b as (select i * 2 as j from a) select sum(j) as s from b", [(20,)]),
    "cte in cte": ("with a as (with b as (select 3 as x) select x + 1 as y from b) select y from a", [(4,)]),
    "cte alias": ("with a as (select 1 as x) select b.x from a b", [(1,)]),
    "subquery": ("select t.j from (select i + 1 as j from generate_series(2)) t order by 1", [(1,), (2,)]),
    "star mix": ("with a as (select 1 as x, 2 as y) select 'k' as k, * from a", [("k", 1, 2)]),
    "function case": ("SELECT Sum(i) AS s FROM Generate_Series(3)", [(3,)]),
    "type names as columns": ("with d as (select 1 as text, 2 as string) select text + string as s from d", [(3,)]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    text, want = CASES[name]
    frame = Engine(spark).sql(text)
    got = [tuple(r) for r in frame.collect()]
    if want and isinstance(want[0], str):
        assert frame.columns == want
    elif "order by" in text:
        assert got == want
    else:
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(
    "text, message",
    [
        ("", "Query is empty"),
        ("-- nothing", "Query is empty"),
        ("select", "Failed to parse query"),
        ("select 'open", "Failed to parse query"),
        ("select 1 as select", "Failed to parse query"),
        ("select * from missing_table", "Table `missing_table` does not exist"),
        ("select x from generate_series(2)", "field x not found"),
        ("with a as (select 1 as x) select x from a cross join (select 2 as x) b", "Ambiguous column: x"),
        ("select nothing(1)", "Function NOTHING not found"),
        ("select nothing(1) over ()", "Window function NOTHING not found"),
        ("select 1 from nothing(1)", "Table function NOTHING not found"),
        ("select i, sum(i) from generate_series(2)", "neither grouped nor aggregated"),
        ("select sum(sum(i)) from generate_series(2)", "nested"),
        ("select sum(i) from generate_series(2) group by 1", "GROUP BY can't name an aggregate"),
        ("select 1 union select 1, 2", "same number of columns"),
        ("select i from generate_series(2) where sum(i) > 1", "WHERE takes neither"),
        ("select pow(1)", "takes 2"),
        ("select I from generate_series(2)", "field I not found"),
    ],
)
def test_errors(spark, text, message):
    with pytest.raises(QueryError, match=message.replace("(", r"\(")):
        Engine(spark).sql(text).collect()


def test_division_by_zero_raises(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        Engine(spark).sql("select 1 / 0 as x").collect()


def test_columns_may_fold_case(spark):
    assert Engine(spark, fold_case=True).run("select I from generate_series(1)") == [{"I": 0}]


def test_duplicate_names_collapse_in_dictionaries(spark):
    assert Engine(spark).run("select 1 as a, 2 as a") == [{"a": 2}]


def test_create_table(spark):
    engine = Engine(spark)
    assert engine.run("create table made_here as (select 1 as i, true as b, 999.5 as f, 'abc' as s)") == [{}]
    assert engine.run("select * from made_here") == [{"i": 1, "b": True, "f": 999.5, "s": "abc"}]
    engine.run("create table made_here as (select i + 1 as i from made_here)")
    assert engine.run("select i from made_here") == [{"i": 2}]
    engine.run("create table own.made_there as (select i from made_here where i > 5)")
    assert engine.run("select * from own.made_there") == []
