"""Syntax tree nodes. Expressions are hashable, so equal ones can be found."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object  # int, float, str, bool or None


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Column(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    type: str


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Over(Expr):
    """A window call. Frame bounds count rows from the current one; None is unbounded."""

    name: str
    args: tuple[Expr, ...]
    partition: tuple[Expr, ...]
    order: tuple[SortKey, ...]
    frame: tuple[int | None, int | None] | None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass
class TableRef:
    parts: tuple[str, ...]
    alias: str | None = None


@dataclass
class FunctionRef:
    name: str
    args: tuple[Expr, ...]
    alias: str | None = None


@dataclass
class SubqueryRef:
    query: "Query"
    alias: str


@dataclass
class Join:
    kind: str  # inner, left, right, full, cross, natural
    source: object
    on: Expr | None = None
    using: tuple[str, ...] = ()


@dataclass
class Select:
    items: list[Item]
    source: object | None
    joins: list[Join]
    where: Expr | None
    group: list[Expr] | None
    having: Expr | None
    distinct: bool


@dataclass
class Query:
    ctes: list[tuple[str, "Query"]]
    branches: list[Select]
    order: list[SortKey]
    limit: int | None


@dataclass
class CreateTable:
    parts: tuple[str, ...]
    query: Query


def children(e: Expr) -> list[Expr]:
    if isinstance(e, Binary):
        return [e.left, e.right]
    if isinstance(e, (Unary, Cast)):
        return [e.operand]
    if isinstance(e, Case):
        return [x for w in e.whens for x in w] + ([e.otherwise] if e.otherwise is not None else [])
    if isinstance(e, Call):
        return list(e.args)
    if isinstance(e, Over):
        return [*e.args, *e.partition, *(k.expr for k in e.order)]
    return []


def walk(e: Expr):
    yield e
    for c in children(e):
        yield from walk(c)
