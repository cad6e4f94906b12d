"""Queries to DataFrames: FROM, JOIN, WHERE, GROUP BY, HAVING, select list, DISTINCT, UNION, ORDER BY, LIMIT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..catalog import Catalog
from ..errors import QueryError
from ..functions import AGGREGATES, TABLES, WINDOWS
from ..functions.typed import Typed, common
from ..sql import tree as t
from .dealing import Dealt, dealt_windows
from .lower import Lowering, constant, needs_order
from .relation import INNER, Field, Relation, fresh


def _aggregates(e: t.Expr) -> list[t.Call]:
    """Aggregate calls in e, outermost only; a window's own call isn't one, but its arguments may hold some."""
    if isinstance(e, t.Call) and e.name in AGGREGATES:
        if any(_aggregates(a) for a in e.args):
            raise QueryError("Aggregate functions can't be nested")
        return [e]
    return [x for c in t.children(e) for x in _aggregates(c)]


def _name(item: t.Item, position: int) -> str:
    if item.alias:
        return item.alias
    return item.expr.name if isinstance(item.expr, t.Column) else f"col_{position}"  # an expanded '*' has aliases


class Planner:
    """`log` collects the operators as nodes and edges, for explain."""

    def __init__(self, catalog: Catalog, fold: bool = False):
        self.catalog, self.spark, self.fold = catalog, catalog.spark, fold
        self.nodes: list[dict] = []
        self.edges: list[tuple[int, int]] = []

    def node(self, name: str, inputs=(), **details) -> int:
        self.nodes.append({"id": len(self.nodes), "name": name, "details": details})
        self.edges += [(i, len(self.nodes) - 1) for i in inputs]
        return len(self.nodes) - 1

    # Queries
    def query(self, q: t.Query, scope: dict[str, tuple[Relation, int]] | None = None) -> tuple[Relation, int]:
        scope = dict(scope or {})
        for name, body in q.ctes:
            scope[name] = self.query(body, scope)
        single = len(q.branches) == 1
        planned = [self.select(s, scope, q.order if single else []) for s in q.branches]
        if single:
            out, at, order = planned[0]
        else:
            out, at = self.union([(r, n) for r, n, _ in planned])
            order = [self.output_order(out, k) for k in q.order]
        if order:
            out, at = Relation(out.frame.orderBy(*order), out.fields), self.node("Sort", [at], keys=len(order))
        if q.limit is not None:
            out, at = Relation(out.frame.limit(q.limit), out.fields), self.node("Limit", [at], limit=q.limit)
        return out, at

    def union(self, parts: list[tuple[Relation, int]]) -> tuple[Relation, int]:
        first = parts[0][0]
        if any(len(r.fields) != len(first.fields) for r, _ in parts):
            raise QueryError("UNION needs the same number of columns on all sides")
        kinds = [common([r.fields[i].kind for r, _ in parts]) for i in range(len(first.fields))]
        casts = {"string": "string", "float": "double", "int": "bigint"}

        def fit(r: Relation):
            return r.frame.select(*(F.col(f.inner).cast(casts[k]) if k in casts and f.kind != k else F.col(f.inner) for f, k in zip(r.fields, kinds)))

        frame = reduce(lambda a, b: a.unionAll(b), (fit(r) for r, _ in parts))
        fields = [Field(f.name, None, fresh(), k) for f, k in zip(first.fields, kinds)]
        return Relation(frame.toDF(*(f.inner for f in fields)), fields), self.node("Union", [n for _, n in parts])

    def output_order(self, out: Relation, k: t.SortKey):
        named = self._output_key(out, k.expr)
        return self._directed(Lowering(out, self.fold)(k.expr).col if named is None else named, k)

    @staticmethod
    def _directed(col, k: t.SortKey):
        return col.desc() if k.descending else col.asc()

    def _output_key(self, out: Relation, e: t.Expr):
        """The output column that an ORDER BY item names, by place or by name."""
        if isinstance(e, t.Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
            if not 1 <= e.value <= len(out.fields):
                raise QueryError(f"ORDER BY position {e.value} is not in the select list")
            return F.col(out.fields[e.value - 1].inner)
        if isinstance(e, t.Column):
            same = [f for f in out.fields if f.name == e.name and (e.table is None or f.table in (None, e.table))]
            if len(same) == 1 or same and e.table is None:
                return F.col(same[-1].inner)
        return None

    # Sources
    def source(self, ref, scope) -> tuple[Relation, int]:
        if isinstance(ref, t.SubqueryRef):
            rel, at = self.query(ref.query, scope)
            return rel.scoped(ref.alias), self.node("Scope", [at], table=ref.alias)
        if isinstance(ref, t.FunctionRef):
            make = TABLES.get(ref.name.upper())
            if make is None:
                raise QueryError(f"Table function {ref.name.upper()} not found")
            args = [constant(a) for a in ref.args]
            return Relation.of(make(self.spark, args), ref.alias), self.node("Generator", function=ref.name.upper(), args=args)
        if len(ref.parts) == 1 and ref.parts[0] in scope:
            rel, at = scope[ref.parts[0]]
            return rel.scoped(ref.alias or ref.parts[0]), self.node("Scope", [at], table=ref.parts[0])
        return Relation.of(self.catalog.find(ref.parts), ref.alias or ref.parts[-1]), self.node("Table Scan", table=".".join(ref.parts))

    def join(self, left: Relation, right: Relation, j: t.Join) -> Relation:
        fields, sides = left.fields + right.fields, left.sides + right.sides
        if j.kind == "cross":
            return Relation(left.frame.crossJoin(right.frame), fields, sides)
        if j.on is not None:
            both = Relation(left.frame, fields, sides)
            return both.over(left.frame.join(right.frame, Lowering(both, self.fold)(j.on).truth(), j.kind))
        names = j.using or tuple(dict.fromkeys(f.name for f in left.fields if any(f.name == g.name for g in right.fields)))
        if not names:
            return Relation(left.frame.crossJoin(right.frame), fields, sides)
        pairs = [(left.find(n, None, self.fold), right.find(n, None, self.fold)) for n in names]
        cond = reduce(lambda a, b: a & b, (F.col(a.inner) == F.col(b.inner) for a, b in pairs))
        kind = "inner" if j.kind == "natural" else j.kind
        frame = left.frame.join(right.frame, cond, kind)
        # One copy of each joined column, as standard SQL has it; qualified names still find either side.
        merged, hidden = [], {f.inner for p in pairs for f in p}
        for a, b in pairs:
            m = Field(a.name, a.table, fresh(), a.kind)
            value = F.coalesce(F.col(a.inner), F.col(b.inner)) if kind == "full" else F.col(b.inner) if kind == "right" else F.col(a.inner)
            frame = frame.withColumn(m.inner, value)
            merged.append(m)
        return Relation(frame, merged + [f for f in fields if f.inner not in hidden], left.sides + right.sides + [f for p in pairs for f in p])

    # One SELECT
    def select(self, s: t.Select, scope, order: list[t.SortKey]) -> tuple[Relation, int, list]:
        if s.source is None:
            rel, at = Relation(self.spark.range(1).select(F.lit(0).alias("_one")), []), self.node("Row Generator")
        else:
            rel, at = self.source(s.source, scope)
        for j in s.joins:
            right, right_at = self.source(j.source, scope)
            rel, at = self.join(rel, right, j), self.node("Join", [at, right_at], kind=j.kind)
        if s.where is not None:
            if any(isinstance(x, t.Over) for x in t.walk(s.where)) or _aggregates(s.where):
                raise QueryError("WHERE takes neither aggregates nor window functions")
            rel, at = rel.over(rel.frame.filter(Lowering(rel, self.fold)(s.where).truth())), self.node("Filter", [at])

        items = self.expand(s.items, rel)
        known: dict[t.Expr, Typed] = {}
        exprs = [i.expr for i in items] + ([s.having] if s.having is not None else []) + [k.expr for k in order if self._plain(k, items)]
        calls = list(dict.fromkeys(c for e in exprs for c in _aggregates(e)))
        if calls or s.group is not None or s.having is not None:
            rel, known = self.aggregate(rel, items, s.group or [], calls, exprs)
            at = self.node("Aggregate", [at], groups=len(s.group or []), aggregates=len(calls))
            if s.having is not None:
                rel, at = rel.over(rel.frame.filter(Lowering(rel, self.fold, known)(s.having).truth())), self.node("Filter", [at], having=True)

        hidden = None
        if any(needs_order(e) for e in exprs):
            hidden = fresh()
            rel = rel.over(rel.frame.withColumn(hidden, F.monotonically_increasing_id()))
        rel, known = self.whole_windows(rel, exprs, known)
        rel, known = self.dealt_windows(rel, exprs, known, hidden)
        lower = Lowering(rel, self.fold, known, hidden)
        fields, cols = [], []
        for n, item in enumerate(items, 1):
            made = lower(item.expr)
            table = rel.find(item.expr.name, item.expr.table, self.fold).table if isinstance(item.expr, t.Column) and item.expr not in known else None
            f = Field(_name(item, n), table, fresh(), made.kind)
            fields.append(f)
            cols.append(made.col.alias(f.inner))
        out = Relation(rel.frame, fields)
        keys, extra = [], []
        for k in order:
            named = self._output_key(out, k.expr)
            if named is None:
                if s.distinct:
                    raise QueryError("ORDER BY of a SELECT DISTINCT must be in the select list")
                name = fresh()
                extra.append(lower(k.expr).col.alias(name))
                named = F.col(name)
            keys.append(self._directed(named, k))
        out = Relation(rel.frame.select(*cols, *extra), fields)
        at = self.node("Projection", [at], columns=[f.name for f in fields])
        if s.distinct:
            out, at = Relation(out.frame.distinct(), fields), self.node("Distinct", [at])
        return out, at, keys

    def _plain(self, k: t.SortKey, items: list[t.Item]) -> bool:
        """Whether an ORDER BY item is an expression over the input, not a name or place of the output."""
        e = k.expr
        return not isinstance(e, t.Literal) and not (isinstance(e, t.Column) and any(_name(i, n) == e.name for n, i in enumerate(items, 1)))

    def expand(self, items: list[t.Item], rel: Relation) -> list[t.Item]:
        out = []
        for i in items:
            if isinstance(i.expr, t.Star):
                found = [f for f in rel.fields if i.expr.table in (None, f.table)]
                if not found:
                    raise QueryError(f"Table `{i.expr.table}` not found" if i.expr.table else "'*' needs a FROM")
                # A name that several tables have stays apart by its inner name.
                out += [t.Item(t.Column(f.inner, INNER), f.name) for f in found]
            else:
                out.append(i)
        return out

    def aggregate(self, rel: Relation, items: list[t.Item], group: list[t.Expr], calls: list[t.Call], exprs: list[t.Expr]):
        keys = []
        for g in group:
            if isinstance(g, t.Literal) and isinstance(g.value, int) and not isinstance(g.value, bool):
                if not 1 <= g.value <= len(items):
                    raise QueryError(f"GROUP BY position {g.value} is not in the select list")
                g = items[g.value - 1].expr
            elif isinstance(g, t.Column) and g.table is None and not any(f.name == g.name for f in rel.fields):
                g = next((i.expr for i in items if i.alias == g.name), g)
            if _aggregates(g):
                raise QueryError("GROUP BY can't name an aggregate")
            keys.append(g)
        lower = Lowering(rel, self.fold)
        frame, hidden = rel.frame, None
        if any(AGGREGATES[c.name].ordered for c in calls):
            hidden = fresh()
            frame = frame.withColumn(hidden, F.monotonically_increasing_id())
        known, cols, fields, resolved = {}, [], [], {}
        for g in dict.fromkeys(keys):
            made, name = lower(g), fresh()
            cols.append(made.col.alias(name))
            known[g] = Typed(F.col(name), made.kind)
            if isinstance(g, t.Column):
                f = rel.find(g.name, g.table, self.fold)
                resolved[f.inner] = known[g]
                fields.append(Field(f.name, f.table, name, made.kind))
        aggs = []
        for c in calls:
            star = not c.args or isinstance(c.args[0], t.Star)
            if star and c.name != "COUNT":
                raise QueryError(f"{c.name} needs an argument")
            delimiter = ","
            if len(c.args) > 1:
                if not AGGREGATES[c.name].ordered or not isinstance(c.args[1], t.Literal):
                    raise QueryError(f"{c.name} takes one argument" if not AGGREGATES[c.name].ordered else "The delimiter must be a string")
                delimiter = str(c.args[1].value)
            made, name = AGGREGATES[c.name].make(None if star else lower(c.args[0]), c.distinct, delimiter, F.col(hidden) if hidden else None), fresh()
            aggs.append(made.col.alias(name))
            known[c] = Typed(F.col(name), made.kind)
        # A grouped column may be written with or without its table.
        for e in exprs:
            self._check(e, rel, known, resolved)
        aggs = aggs or [F.count(F.lit(1)).alias(fresh())]
        frame = frame.groupBy(*cols).agg(*aggs) if cols else frame.agg(*aggs)
        return Relation(frame, fields), known

    def _check(self, e: t.Expr, rel: Relation, known: dict, resolved: dict) -> None:
        if e in known:
            return
        if isinstance(e, t.Column):
            f = rel.find(e.name, e.table, self.fold)
            if f.inner not in resolved:
                raise QueryError(f"Field {e.name} is neither grouped nor aggregated")
            known[e] = resolved[f.inner]
        for c in t.children(e):
            self._check(c, rel, known, resolved)

    def whole_windows(self, rel: Relation, exprs: list[t.Expr], known: dict):
        """Windows over all rows: one aggregate row beside every row, instead of all rows in one task.

        An order changes nothing in a frame of all rows, where the function commutes.
        """

        def whole(x) -> bool:
            if not isinstance(x, t.Over) or x in known or x.partition or x.name not in WINDOWS or not WINDOWS[x.name].framed:
                return False
            return x.frame in (None, (None, None)) and (WINDOWS[x.name].commutes or not x.order and x.frame is None)

        found = list(dict.fromkeys(x for e in exprs for x in t.walk(e) if whole(x)))
        if not found:
            return rel, known
        lower, known, aggs = Lowering(rel, self.fold, known), dict(known), []
        for x in found:
            made, name = WINDOWS[x.name].make([] if x.name == "COUNT" else [lower(a) for a in x.args]), fresh()
            aggs.append(made.col.alias(name))
            known[x] = Typed(F.col(name), made.kind)
        return rel.over(rel.frame.crossJoin(F.broadcast(rel.frame.agg(*aggs)))), known

    def dealt_windows(self, rel: Relation, exprs: list[t.Expr], known: dict, hidden: str | None):
        """All other windows whose function says how: dealt by range, so that no task holds a whole partition."""

        def bounds(x: t.Over) -> tuple[int | None, int | None]:
            if x.name == "ROW_NUMBER":
                return None, 0
            if not WINDOWS[x.name].framed:  # LAG and LEAD
                n = x.args[1].value if len(x.args) > 1 else 1
                return (-n, 0) if x.name == "LAG" else (0, n)
            return x.frame or (None, None)

        def fits(x) -> bool:
            if not isinstance(x, t.Over) or x in known or x.name not in WINDOWS:
                return False
            function = WINDOWS[x.name]
            if any(isinstance(y, t.Over) for c in t.children(x) for y in t.walk(c)):
                return False
            return function.framed or x.name in ("ROW_NUMBER", "LAG", "LEAD")

        found = list(dict.fromkeys(x for e in exprs for x in t.walk(e) if fits(x)))
        frame, lower, known, names = rel.frame, Lowering(rel, self.fold, known), dict(known), {}
        groups: dict[tuple, list[Dealt]] = {}

        def column(e: t.Expr) -> str:
            nonlocal frame
            if e not in names:
                names[e] = rel.find(e.name, e.table, self.fold).inner if isinstance(e, t.Column) and e not in known else fresh()
                if names[e] not in frame.columns:
                    frame = frame.withColumn(names[e], lower(e).col)
            return names[e]

        for x in found:
            function = WINDOWS[x.name]
            args = [] if x.name in ("ROW_NUMBER", "COUNT") else [lower(a) for a in x.args]
            made, name = function.make(args), fresh()
            low, high = bounds(x)
            if None in (low, high) and (function.merge is None or function.framed and self._decimal_mean(frame, x, made)):
                continue
            named = [a if isinstance(e, t.Literal) else Typed(F.col(column(e)), a.kind) for a, e in zip(args, x.args)]
            order = tuple((column(k.expr), k.descending) for k in x.order) or (((hidden, False),) if hidden else ())
            key = tuple(column(p) for p in x.partition), order
            groups.setdefault(key, []).append(Dealt(name, function.make(named).col, [a.col for a in named], low, high, function.merge, function.framed))
            known[x] = Typed(F.col(name), made.kind)
        for (partition, order), calls in groups.items():
            frame = dealt_windows(frame, list(partition), list(order), calls)
        return rel.over(frame), known

    @staticmethod
    def _decimal_mean(frame, x: t.Over, made: Typed) -> bool:
        """Means of decimals are decimals, which sums of doubles don't give."""
        return x.name in ("AVG", "MEAN") and frame.select(made.col).dtypes[0][1].startswith("decimal")
