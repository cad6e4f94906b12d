"""Columns with the little that lowering needs to know of their types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: int, float, string, bool, null, other
_KINDS = ((T.BooleanType, "bool"), (T.StringType, "string"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType, T.DecimalType), "float"), (T.NullType, "null"))


def kind_of(dtype: T.DataType) -> str:
    return next((k for c, k in _KINDS if isinstance(dtype, c)), "other")


@dataclass
class Typed:
    col: Column
    kind: str

    def truth(self) -> Column:
        """As a condition: numbers other than 0 and strings other than '' hold."""
        if self.kind in ("int", "float"):
            return self.col != F.lit(0)
        if self.kind == "string":
            return self.col != F.lit("")
        if self.kind == "null":
            return self.col.cast("boolean")
        return self.col


def common(kinds: list[str]) -> str:
    """The kind that holds values of all these kinds; strings where they don't fit."""
    found = {k for k in kinds if k != "null"}
    if not found:
        return "null"
    if len(found) == 1:
        return found.pop()
    return "float" if found == {"int", "float"} else "string"


def unify(values: list[Typed]) -> tuple[list[Column], str]:
    kind = common([v.kind for v in values])
    cast = {"float": "double", "string": "string", "int": "bigint"}.get(kind)
    return [v.col.cast(cast) if cast and v.kind != kind else v.col for v in values], kind
