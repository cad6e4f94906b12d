"""Aggregate functions: make(argument, distinct, delimiter, order column) -> typed column.

The argument is None for COUNT(*). The order column, where a function asks for it, numbers the input rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .typed import Typed


@dataclass
class Aggregate:
    make: Callable[[Typed | None, bool, str, Column | None], Typed]
    ordered: bool = False


AGGREGATES: dict[str, Aggregate] = {}


def register_aggregate(name: str, make, ordered: bool = False) -> None:
    AGGREGATES[name.upper()] = Aggregate(make, ordered)


def list_agg(value: Column, delimiter: str, order: Column, distinct: bool = False) -> Column:
    """Values joined in the order given; DISTINCT keeps the first of equal ones. Nulls are left out."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("string").alias("v")))))
    values = F.transform(pairs, lambda p: p["v"])
    return F.array_join(F.array_distinct(values) if distinct else values, delimiter)


def _count(arg, distinct, delimiter, order):
    """Rows, those with null values as well; DISTINCT: different values."""
    return Typed(F.count_distinct(arg.col) if distinct and arg is not None else F.count(F.lit(1)), "int")


def _sum(arg, distinct, delimiter, order):
    return Typed((F.sum_distinct if distinct else F.sum)(arg.col), arg.kind if arg.kind in ("int", "float") else "float")


def _avg(arg, distinct, delimiter, order):
    return Typed(F.sum_distinct(arg.col) / F.count_distinct(arg.col) if distinct else F.avg(arg.col), "float")


register_aggregate("MIN", lambda a, d, x, o: Typed(F.min(a.col), a.kind))
register_aggregate("MAX", lambda a, d, x, o: Typed(F.max(a.col), a.kind))
register_aggregate("SUM", _sum)
register_aggregate("AVG", _avg)
register_aggregate("COUNT", _count)
for _name in ("LISTAGG", "LIST_AGG"):
    register_aggregate(_name, lambda a, d, x, o: Typed(list_agg(a.col, x, o, d), "string"), ordered=True)
