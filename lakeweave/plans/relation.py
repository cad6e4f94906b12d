"""What a FROM item or a query is while it is planned: a DataFrame whose columns have names of their own."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.typed import Typed, kind_of

#: As a table name: the column's name is an inner one.
INNER = "\0inner"
_count = itertools.count()


def fresh() -> str:
    return f"_c{next(_count)}"


@dataclass(frozen=True)
class Field:
    name: str
    table: str | None
    inner: str
    kind: str


@dataclass
class Relation:
    frame: DataFrame
    fields: list[Field]
    #: Columns that a USING or NATURAL join has merged; only qualified names find them.
    sides: list[Field] = field(default_factory=list)

    @classmethod
    def of(cls, frame: DataFrame, table: str | None) -> "Relation":
        """A DataFrame's columns, scoped to a table name, under fresh inner names."""
        fields = [Field(f.name, table, fresh(), kind_of(f.dataType)) for f in frame.schema.fields]
        return cls(frame.toDF(*(f.inner for f in fields)), fields)

    def over(self, frame: DataFrame) -> "Relation":
        """The same columns in another frame."""
        return Relation(frame, self.fields, self.sides)

    def scoped(self, table: str) -> "Relation":
        """The same rows under another table name; again with fresh names, so that a self-join has no clash."""
        fields = [Field(f.name, table, fresh(), f.kind) for f in self.fields]
        return Relation(self.frame.select(*(F.col(a.inner).alias(b.inner) for a, b in zip(self.fields, fields))), fields)

    def find(self, name: str, table: str | None, fold: bool = False) -> Field:
        if table == INNER:
            return next(f for f in self.fields if f.inner == name)
        same = (lambda a, b: a is not None and a.lower() == b.lower()) if fold else (lambda a, b: a == b)
        found = [f for f in self.fields if same(f.name, name) and (table is None or same(f.table, table))]
        if not found and table is not None:
            found = [f for f in self.sides if same(f.name, name) and same(f.table, table)]
        full = f"{table}.{name}" if table else name
        if not found:
            raise QueryError(f"field {full} not found in table")
        if len(found) > 1:
            raise QueryError(f"Ambiguous column: {full}")
        return found[0]

    def column(self, f: Field) -> Typed:
        return Typed(F.col(f.inner), f.kind)

    def output(self) -> DataFrame:
        return self.frame.select(*(F.col(f.inner) for f in self.fields)).toDF(*(f.name for f in self.fields))
