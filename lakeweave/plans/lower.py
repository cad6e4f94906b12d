"""Expressions to Columns."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import AGGREGATES, SCALARS, WINDOWS
from ..functions.typed import Typed, common, unify
from ..sql import tree as t
from .relation import Relation

_CASTS = {"int": ("bigint", "int"), "float": ("double", "float"), "string": ("string", "string"), "text": ("string", "string")}


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "int")
    return Typed(F.lit(value), "float" if isinstance(value, float) else "string")


class Lowering:
    """Expressions over one relation. `known` maps whole expressions to columns already computed (groups, aggregates)."""

    def __init__(self, relation: Relation, fold: bool, known: dict[t.Expr, Typed] | None = None, order: str | None = None):
        self.relation, self.fold, self.known, self.order = relation, fold, known or {}, order

    def __call__(self, e: t.Expr) -> Typed:
        if e in self.known:
            return self.known[e]
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _literal(self, e: t.Literal) -> Typed:
        out = literal(e.value)
        out.constant = e.value
        return out

    def _column(self, e: t.Column) -> Typed:
        return self.relation.column(self.relation.find(e.name, e.table, self.fold))

    def _star(self, e: t.Star) -> Typed:
        raise QueryError("'*' may stand only in a select list or in COUNT(*)")

    def _unary(self, e: t.Unary) -> Typed:
        x = self(e.operand)
        return Typed(-x.col, x.kind) if e.op == "-" else Typed(~x.truth(), "bool")

    def _cast(self, e: t.Cast) -> Typed:
        to, kind = _CASTS[e.type]
        return Typed(self(e.operand).col.cast(to), kind)

    def _case(self, e: t.Case) -> Typed:
        values = [self(v) for _, v in e.whens] + ([self(e.otherwise)] if e.otherwise is not None else [])
        cols, kind = unify(values)
        out = None
        for (cond, _), value in zip(e.whens, cols):
            out = F.when(self(cond).truth(), value) if out is None else out.when(self(cond).truth(), value)
        return Typed(out.otherwise(cols[-1]) if e.otherwise is not None else out, kind)

    def _binary(self, e: t.Binary) -> Typed:
        a, b = self(e.left), self(e.right)
        op = e.op
        if op in ("and", "or"):
            return Typed(a.truth() & b.truth() if op == "and" else a.truth() | b.truth(), "bool")
        if op in ("is", "is not"):
            same = a.col.isNull() if b.kind == "null" else a.col.eqNullSafe(b.col) if common([a.kind, b.kind]) != "string" or a.kind == b.kind else F.lit(False)
            return Typed(~same if op == "is not" else same, "bool")
        if {a.kind, b.kind} & {"int", "float"}:  # beside a number a boolean counts as 0 or 1
            a, b = (Typed(x.col.cast("bigint"), "int") if x.kind == "bool" else x for x in (a, b))
        if op in ("=", "!=", "<", ">", "<=", ">="):
            kinds = {a.kind, b.kind}
            if op in ("=", "!=") and "string" in kinds and kinds & {"int", "float", "bool"}:  # never equal
                return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!=")), "bool")
            made = {"=": a.col == b.col, "!=": a.col != b.col, "<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}
            return Typed(made[op], "bool")
        if op == "+" and {a.kind, b.kind} <= {"string", "null"} and "string" in (a.kind, b.kind):
            return Typed(F.concat(a.col, b.col), "string")
        if op == "*" and {a.kind, b.kind} == {"string", "int"}:
            s, n = (a, b) if a.kind == "string" else (b, a)
            return Typed(F.repeat(s.col, n.col.cast("int")), "string")
        if op == "/":
            return Typed(a.col.cast("double") / b.col.cast("double"), "float")
        made = {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}
        return Typed(made[op], common([a.kind, b.kind]))

    def _call(self, e: t.Call) -> Typed:
        if e.name in SCALARS:
            return SCALARS[e.name]([self(a) for a in e.args])
        if e.name in AGGREGATES:
            raise QueryError(f"Aggregate function {e.name} is not allowed here")
        raise QueryError(f"Function {e.name} not found")

    def _over(self, e: t.Over) -> Typed:
        if e.name not in WINDOWS:
            raise QueryError(f"Window function {e.name} not found")
        function = WINDOWS[e.name]
        args = [] if e.name in ("ROW_NUMBER", "COUNT") else [self(a) for a in e.args]
        window = W.partitionBy(*(self(p).col for p in e.partition))
        low, high = (e.frame or (None, None)) if function.framed else (None, None)
        # A frame that only its start bounds is a running frame of the reversed order: one step a row instead of one a row of the frame.
        back = function.commutes and low is not None and high is None
        if back:
            low, high = None, -low
        order = [self(k.expr).col.desc() if k.descending != back else self(k.expr).col.asc() for k in e.order]
        if not order and (e.frame is not None or not function.framed):
            order = [F.col(self.order).desc() if back else F.col(self.order).asc()]
        if order:
            window = window.orderBy(*order)
        if function.framed:
            window = window.rowsBetween(W.unboundedPreceding if low is None else low, W.unboundedFollowing if high is None else high)
        made = function.make(args)
        out = made.col.over(window)
        return Typed(out.cast("bigint") if e.name == "ROW_NUMBER" else out, made.kind)


def needs_order(e: t.Expr) -> bool:
    """Whether a window in e falls back on the input's order."""
    return any(isinstance(x, t.Over) and not x.order and (x.frame is not None or not (x.name in WINDOWS and WINDOWS[x.name].framed)) for x in t.walk(e))


def constant(e: t.Expr):
    """The value of an expression without columns, as table functions need it when they are planned."""
    if isinstance(e, t.Literal):
        return e.value
    if isinstance(e, t.Unary) and e.op == "-":
        return -constant(e.operand)
    if isinstance(e, t.Cast):
        value = constant(e.operand)
        return None if value is None else {"int": int, "float": float}.get(e.type, str)(value)
    if isinstance(e, t.Binary) and e.op in ("+", "-", "*", "/"):
        a, b = constant(e.left), constant(e.right)
        return a + b if e.op == "+" else a - b if e.op == "-" else a * b if e.op == "*" else a / b
    if isinstance(e, t.Call) and e.name in ("SIN", "COS", "POW"):
        args = [constant(a) for a in e.args]
        return args[0] ** args[1] if e.name == "POW" else getattr(math, e.name.lower())(*args)
    raise QueryError("Arguments of a table function must be constant")
