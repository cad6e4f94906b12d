"""Scalar functions: from typed arguments to a typed column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..errors import QueryError
from .typed import Typed, unify

SCALARS: dict[str, Callable[[list[Typed]], Typed]] = {}


def register_scalar(name: str, arity: int | None, make: Callable[[list[Typed]], Typed]) -> None:
    def checked(args: list[Typed]) -> Typed:
        if arity is not None and len(args) != arity:
            raise QueryError(f"{name.upper()} takes {arity} argument(s), not {len(args)}")
        return make(args)

    SCALARS[name.upper()] = checked


def square_wave(x):
    """1 where the sine is positive, else -1."""
    return F.when(F.sin(x) > 0, F.lit(1).cast("bigint")).when(x.isNotNull(), F.lit(-1).cast("bigint"))


def _iff(args: list[Typed]) -> Typed:
    (yes, no), kind = unify(args[1:])
    return Typed(F.when(args[0].truth(), yes).otherwise(no), kind)


register_scalar("SIN", 1, lambda a: Typed(F.sin(a[0].col), "float"))
register_scalar("COS", 1, lambda a: Typed(F.cos(a[0].col), "float"))
register_scalar("SQR", 1, lambda a: Typed(square_wave(a[0].col), "int"))
register_scalar("POW", 2, lambda a: Typed(F.pow(a[0].col, a[1].col), "float"))
register_scalar("IFF", 3, _iff)
