"""Window functions: make(arguments, window) -> typed column.

`framed` functions work on the frame; the others on the whole ordered partition, whatever frame is given, and need an
order (the input's, where the query gives none). `commutes`: a frame's order doesn't matter to the function, so that a
frame may be walked backwards. `merge`: how totals of some of a frame's rows stand for them; without it, an unbounded frame
is worked through in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .typed import Typed


@dataclass
class Merge:
    """`rows` gives a row's values, `folds` the aggregate of each, which takes values and its own results, `finish` the result."""

    rows: Callable[[list[Column]], list[Column]]
    folds: list[Callable[[Column], Column]]
    finish: Callable[[list[Column]], Column]


@dataclass
class WindowFunction:
    make: Callable[[list[Typed]], Typed]
    framed: bool
    commutes: bool = False
    merge: Merge | None = None


WINDOWS: dict[str, WindowFunction] = {}


def register_window(name: str, make: Callable[[list[Typed]], Typed], framed: bool = True, commutes: bool = False, merge: Merge | None = None) -> None:
    WINDOWS[name.upper()] = WindowFunction(make, framed, commutes, merge)


_COUNTED = Merge(lambda a: [F.lit(1).cast("bigint")], [F.sum], lambda v: F.coalesce(v[0], F.lit(0).cast("bigint")))
_MEAN = Merge(lambda a: [a[0].cast("double"), F.when(a[0].isNotNull(), F.lit(1).cast("bigint"))], [F.sum, F.sum], lambda v: F.when(v[1] > 0, v[0] / v[1]))


def _itself(make: Callable[[Column], Column]) -> Merge:
    return Merge(lambda a: a, [make], lambda v: v[0])


def _one(name: str, make: Callable[[Column], Column], kind: str | None = None, merge: Merge | None = None) -> None:
    def checked(args: list[Typed]) -> Typed:
        if len(args) != 1:
            raise QueryError(f"Window function {name} takes one argument")
        return Typed(make(args[0].col), kind or args[0].kind)

    register_window(name, checked, commutes=True, merge=merge or _itself(make))


def _shift(name: str, make) -> None:
    def checked(args: list[Typed]) -> Typed:
        if len(args) not in (1, 2):
            raise QueryError(f"Window function {name} takes one or two arguments")
        n = 1
        if len(args) == 2:
            n = args[1].constant if hasattr(args[1], "constant") else None
            if not isinstance(n, int):
                raise QueryError(f"The offset of {name} must be a whole number")
        return Typed(make(args[0].col, n), args[0].kind)

    register_window(name, checked, framed=False)


register_window("COUNT", lambda a: Typed(F.count(F.lit(1)), "int"), commutes=True, merge=_COUNTED)
register_window("ROW_NUMBER", lambda a: Typed(F.row_number(), "int"), framed=False, merge=_COUNTED)
_one("SUM", F.sum)
_one("MIN", F.min)
_one("MAX", F.max)
_one("AVG", F.avg, "float", _MEAN)
_one("MEAN", F.avg, "float", _MEAN)
_shift("LAG", F.lag)
_shift("LEAD", F.lead)
