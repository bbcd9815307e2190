"""Algebra to DataFrames.

A solution set is a DataFrame with one column for each variable, the variables' static types, and the variables that may be
unbound. Joins on variables that are bound on both sides are equi-joins; others are null-aware. Everything stays lazy but for
closures of property paths, whose rounds are written out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.scalar import FUNCTIONS
from ..functions.values import BOOL, DBL, INT, IRI, STR, TERM, Type, Val
from ..operators.lineage import spread
from . import algebra as A


#: Rows of one value that meet in one task.
CELL = 512

#: Parts of the rows of one value that are sorted apart.
SHARDS = 8


class Unsupported(ValueError):
    """The query uses something that isn't offered."""


@dataclass
class Solutions:
    df: DataFrame
    types: dict[str, Type]
    maybe: set[str] = field(default_factory=set)

    def val(self, name: str) -> Val:
        return Val(self.types[name], self.df[name])


@dataclass(frozen=True)
class Context:
    graph: Any = None  # None, Iri or Var
    default: tuple = ()  # FROM
    named: tuple = ()  # FROM NAMED
    max_depth: int = 100
    min_confidence: float | None = None


class Compiler:
    def __init__(self, source: Any, spark: SparkSession | None = None, services: dict[str, Any] | None = None, aggregates: dict[str, Any] | None = None):
        self.source = source
        self.spark = spark or source.spark
        self.services = services or {}
        self.aggregates = aggregates or {}
        self.count = 0

    # -- patterns
    def solve(self, node: Any, ctx: Context) -> Solutions:
        return getattr(self, "_" + type(node).__name__.lower())(node, ctx)

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), {})

    def empty(self, types: dict[str, Type]) -> Solutions:
        cols = [F.lit(None).cast(SQL_TYPE.get(t.kind, "bigint")).alias(n) for n, t in types.items()]
        return Solutions(self.spark.range(0).select(*cols), dict(types))

    def _bgp(self, node: A.Bgp, ctx: Context) -> Solutions:
        triples = list(dict.fromkeys(node.triples))
        if not triples:
            return self.unit()
        parts: list[Solutions] = []
        stars: dict[Any, list] = {}
        for t in triples:
            if isinstance(t.p, A.Path):
                parts.append(self.path_pattern(t, ctx))
            else:
                stars.setdefault(_as_var(t.s), []).append((t.p, _as_var(t.o)))
        weight, subject = {}, {}
        for s, pairs in stars.items():
            sol = self.star(s, pairs, ctx)
            subject[id(sol)] = set(_vars_of(s))
            weight[id(sol)] = sum(not isinstance(x, A.Var) for x in (s, *(o for _, o in pairs)))
            parts.append(sol)
        # connected first, most constants first
        parts.sort(key=lambda x: -weight.get(id(x), 0))
        out = parts.pop(0)
        subjects = subject.get(id(out))
        while parts:
            i = next((i for i, p in enumerate(parts) if set(p.types) & set(out.types)), 0)
            part = parts.pop(i)
            own, shared = subject.get(id(part)), set(part.types) & set(out.types)
            # rows of tables that share values and no row: many meet many
            many = getattr(self.source, "row_subjects", False) and shared and subjects and own and not shared & (subjects | own)
            out = self.many_to_many(out, part) if many else self.join(out, part)
            subjects = subjects | own if subjects and own else None
        return out

    def star(self, s: Any, pairs: list, ctx: Context) -> Solutions:
        names: list[str] = []
        for x in (s, *(x for p in pairs for x in p), *([ctx.graph] if isinstance(ctx.graph, A.Var) else [])):
            for n in _vars_of(x):
                if n not in names:
                    names.append(n)
        found = [Solutions(df, types) for df, types in self.source.star(s, pairs, ctx)]
        if not found:
            return self.empty({n: TERM for n in names})
        out = found[0]
        for x in found[1:]:
            out = self.both(out, x)
        return out

    def both(self, a: Solutions, b: Solutions) -> Solutions:
        """Bag union."""
        types: dict[str, Type] = {}
        for n in [*a.types, *b.types]:
            types[n] = V.unify(a.types.get(n, b.types.get(n)), b.types.get(n, a.types.get(n)))
        side = lambda s: s.df.select(*[(V.convert(s.val(n), t) if n in s.types else F.lit(None)).alias(n) for n, t in types.items()])
        x, y = side(a), side(b)
        maybe = a.maybe | b.maybe | (set(a.types) ^ set(b.types))
        return Solutions(x.unionByName(y) if types else x.union(y), types, maybe)

    def _aligned(self, a: Solutions, b: Solutions) -> tuple[Solutions, list[tuple[str, str, bool]]]:
        """b with columns that a has renamed, and for each shared variable (name, new name, certainly bound)."""
        shared = [n for n in b.types if n in a.types]
        self.count += 1
        new = {n: f"__r{self.count}_{n}" for n in shared}
        df = b.df.select(*[b.df[n].alias(new.get(n, n)) for n in b.types])
        types = {new.get(n, n): t for n, t in b.types.items()}
        return Solutions(df, types, {new.get(n, n) for n in b.maybe}), [(n, new[n], n not in a.maybe and n not in b.maybe) for n in shared]

    def _match(self, a: Solutions, b: Solutions, shared: list) -> Column | None:
        cond: Column | None = None
        for n, m, certain in shared:
            x, y = a.val(n), b.val(m)
            same = V.same_term(x, y) if not (x.kind == y.kind == "ref" and x.type != y.type) else F.lit(False)
            if x.kind in V.NUMERIC and y.kind in V.NUMERIC:
                same = x.col == y.col
            if not certain:
                same = same | x.col.isNull() | y.col.isNull()
            cond = same if cond is None else cond & same
        return cond

    def join(self, a: Solutions, b: Solutions) -> Solutions:
        b, shared = self._aligned(a, b)
        if shared and not any(certain for _, _, certain in shared):
            return self._split(a, b, shared)
        return self._joined(a, b, shared, self._match(a, b, shared))

    def many_to_many(self, a: Solutions, b: Solutions) -> Solutions:
        """A join on values that many rows of both sides have: b's rows of one value are dealt to cells of about CELL, which a's rows
        all visit. So a frequent value is spread over tasks, and visits grow with the result over CELL."""
        b, shared = self._aligned(a, b)
        if not all(certain and a.types[n] == b.types[m] for n, m, certain in shared):
            return self._joined(a, b, shared, self._match(a, b, shared))
        size = b.df.groupBy(*[F.col(m).alias(f"__k{i}") for i, (_, m, _) in enumerate(shared)]).agg(F.ceil(F.count("*") / CELL).cast("int").alias("__cells")).hint("merge")
        sized = lambda df, at: df.join(size, [F.col(x[at]) == F.col(f"__k{i}") for i, x in enumerate(shared)])
        x = sized(a.df, 0).select(*a.types, F.explode(F.sequence(F.lit(0), F.col("__cells") - 1)).alias("__visited"))
        y = sized(b.df, 1).select(*b.types, F.pmod(F.xxhash64(*b.types), F.col("__cells")).cast("int").alias("__cell"))
        x, y = spread(x, *[n for n, _, _ in shared], "__visited"), spread(y, *[m for _, m, _ in shared], "__cell")
        x, y = x.toDF(*x.columns), y.toDF(*y.columns)  # columns of their own: both sides hold b's sizes
        a, b = Solutions(x, a.types, a.maybe), Solutions(y, b.types, b.maybe)
        return self._joined(a, b, shared, self._match(a, b, shared) & (x["__visited"] == y["__cell"]))

    def _split(self, a: Solutions, b: Solutions, shared: list) -> Solutions:
        """A join without a variable that is bound on both sides for sure: rows that have the first one are joined on it.

        Only rows without it, which are compatible with all others by definition, meet all rows of the other side.
        """
        n, m, _ = shared[0]
        rest = shared[1:]
        some = lambda s, x, bound: Solutions(s.df.where(s.df[x].isNotNull() if bound else s.df[x].isNull()), s.types, s.maybe)
        parts = []
        for x, y, on in ((some(a, n, True), some(b, m, True), [(n, m, True), *rest]), (some(a, n, False), b, rest), (some(a, n, True), some(b, m, False), rest)):
            parts.append(self._joined(x, y, shared, self._match(x, y, on)))
        out = parts[0].df
        for p in parts[1:]:
            out = out.unionByName(p.df)
        return Solutions(out, parts[0].types, parts[0].maybe)

    def _joined(self, a: Solutions, b: Solutions, shared: list, cond: Column | None) -> Solutions:
        """Rows of both sides that fit by the condition, with one column for each shared variable."""
        df = a.df.crossJoin(b.df) if cond is None else a.df.join(b.df, cond, "inner")
        cols, types, maybe = [], {}, set()
        gone = {m: n for n, m, _ in shared}
        for n, t in a.types.items():
            m = next((m for k, m, c in shared if k == n and not c), None)
            if m is None:
                cols.append(a.df[n])
                types[n] = t
                if n in a.maybe and n not in {k for k, _, _ in shared}:
                    maybe.add(n)
            else:
                types[n] = V.unify(t, b.types[m])
                cols.append(F.coalesce(V.convert(a.val(n), types[n]), V.convert(b.val(m), types[n])).alias(n))
                if n in a.maybe and m in b.maybe:
                    maybe.add(n)
        for m, t in b.types.items():
            if m not in gone:
                cols.append(b.df[m])
                types[m] = t
                if m in b.maybe:
                    maybe.add(m)
        return Solutions(df.select(*cols), types, maybe)

    def _join(self, node: A.Join, ctx: Context) -> Solutions:
        return self.join(self.solve(node.left, ctx), self.solve(node.right, ctx))

    def _leftjoin(self, node: A.LeftJoin, ctx: Context) -> Solutions:
        a, right = self.solve(node.left, ctx), node.right
        b = self.solve(right, ctx)
        on = node.on
        if on is not None and _has_exists(on):  # needs joins of its own: it goes to the right side
            b = self._filtered(b, on, ctx)
            on = None
        b, shared = self._aligned(a, b)
        if on is not None and getattr(self.source, "row_subjects", False):
            left, own = _subjects(node.left), _subjects(right)
            keys_only = all(certain and a.types[n] == b.types[m] for n, m, certain in shared)
            if left and own and keys_only and not {n for n, _, _ in shared} & (left | own):
                out = self._left_by_range(a, b, shared, on, ctx)
                if out is not None:
                    return out
        cond = self._match(a, b, shared)
        if on is not None:
            scope = {n: a.val(n) for n in a.types} | {n: b.val(n) for n in b.types if n not in {m for _, m, _ in shared}}
            for n, m, certain in shared:
                if not certain:
                    t = V.unify(a.types[n], b.types[m])
                    scope[n] = Val(t, F.coalesce(V.convert(a.val(n), t), V.convert(b.val(m), t)))
            test = V.truth(self.expression(on, scope, ctx))
            cond = test if cond is None else cond & test
        df = a.df.join(b.df, F.lit(True) if cond is None else cond, "left")
        cols, types, maybe = [], {}, set()
        for n, t in a.types.items():
            m = next((m for k, m, _ in shared if k == n and n in a.maybe), None)
            types[n] = t if m is None else V.unify(t, b.types[m])
            cols.append(a.df[n] if m is None else F.coalesce(V.convert(a.val(n), types[n]), V.convert(b.val(m), types[n])).alias(n))
            if n in a.maybe:
                maybe.add(n)
        for m, t in b.types.items():
            if m not in {x for _, x, _ in shared}:
                cols.append(b.df[m])
                types[m] = t
                maybe.add(m)
        return Solutions(df.select(*cols), types, maybe)

    def _left_by_range(self, a: Solutions, b: Solutions, shared: list, on: Any, ctx: Context) -> Solutions | None:
        """A left join on values that many rows of both sides have and on one comparison between the sides; None if on isn't that.

        b's rows of one value are sorted by their side of the comparison, in SHARDS parts, and cut into cells of CELL rows. A row of a
        visits the cells whose extreme fits, so that it meets a partner in each of them and few rows that are none, or else no cell.
        """
        mine, theirs = set(a.types), {n for n in b.types if n not in {m for _, m, _ in shared}}
        scope = {n: a.val(n) for n in mine} | {n: b.val(n) for n in theirs}
        tests, right, ranges = [], [], []
        for e in _conjuncts(on):
            if not _expr_vars(e) & mine:
                right.append(V.truth(self.expression(e, scope, ctx)))
            elif not _expr_vars(e) & theirs:
                tests.append(V.truth(self.expression(e, scope, ctx)))
            elif isinstance(e, A.Call) and e.op in _FLIPPED and not any(_expr_vars(x) & mine and _expr_vars(x) & theirs for x in e.args):
                x, y, op = (*e.args, e.op) if _expr_vars(e.args[0]) & theirs else (*reversed(e.args), _FLIPPED[e.op])
                ranges.append((self.expression(x, scope, ctx), self.expression(y, scope, ctx), op))
            else:
                return None
        if len(ranges) != 1 or "term" in (ranges[0][0].kind, ranges[0][1].kind):
            return None
        value, bound, op = ranges[0]
        keys = [m for _, m, _ in shared]
        at = [*keys, "__shard", "__cell"]
        sort = Window.partitionBy(*keys, "__shard").orderBy("__value")
        y = b.df
        for t in right:
            y = y.where(t)
        y = y.select(*b.types, value.col.alias("__value"), F.pmod(F.xxhash64(*b.types), F.lit(SHARDS)).cast("int").alias("__shard")).where(F.col("__value").isNotNull())
        y = y.withColumn("__cell", F.floor((F.row_number().over(sort) - 1) / CELL).cast("int"))
        names = {c: f"__of{i}" for i, c in enumerate(at)}
        cells = y.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg((F.max if op[0] == ">" else F.min)("__value").alias("__extreme"))
        x = spread(a.df.select(*a.types, bound.col.alias("__bound"), *[t.alias(f"__t{i}") for i, t in enumerate(tests)]), *a.types)
        fits = V.less(Val(value.type, cells["__extreme"]), Val(bound.type, x["__bound"]), op)
        for i in range(len(tests)):
            fits = fits & x[f"__t{i}"]
        for n, m, _ in shared:
            fits = fits & (x[n] == cells[names[m]])
        x = x.join(cells, fits, "left").select(*a.types, "__bound", *[F.col(names[c]).alias(f"__visited{i}") for i, c in enumerate(at)])
        x, y = spread(x, *[f"__visited{i}" for i in range(len(at))]), spread(y, *at)
        x, y = x.toDF(*x.columns), y.toDF(*y.columns)  # columns of their own: both sides hold b's
        cond = V.less(Val(value.type, y["__value"]), Val(bound.type, x["__bound"]), op)
        for i, c in enumerate(at):
            cond = cond & (x[f"__visited{i}"] == y[c])
        gained = [n for n in b.types if n in theirs]
        df = x.join(y, cond, "left").select(*[x[n] for n in a.types], *[y[n] for n in gained])
        return Solutions(df, a.types | {n: b.types[n] for n in gained}, a.maybe | set(gained))

    def _union(self, node: A.Union, ctx: Context) -> Solutions:
        out = self.solve(node.parts[0], ctx)
        for p in node.parts[1:]:
            out = self.both(out, self.solve(p, ctx))
        return out

    def _minus(self, node: A.Minus, ctx: Context) -> Solutions:
        a, b = self.solve(node.left, ctx), self.solve(node.right, ctx)
        b, shared = self._aligned(a, b)
        if not shared:
            return a
        cond = self._match(a, b, shared)
        if not any(c for _, _, c in shared):  # at least one variable must be bound on both sides
            some = F.lit(False)
            for n, m, _ in shared:
                some = some | (a.df[n].isNotNull() & b.df[m].isNotNull())
            cond = cond & some
        return Solutions(a.df.join(b.df, cond, "left_anti"), a.types, a.maybe)

    def _lateral(self, node: A.Lateral, ctx: Context) -> Solutions:
        """The right side once for each left solution: slices and orders inside it are taken within each."""
        a = self.solve(node.left, ctx)
        inner, limit, offset, order = node.right, None, 0, ()
        if isinstance(inner, A.Slice):
            inner, limit, offset = inner.inner, inner.limit, inner.offset
        if isinstance(inner, A.Project) and isinstance(inner.inner, A.OrderBy):
            order, inner = inner.inner.keys, A.Project(inner.inner.inner, inner.vars)
        if limit is None and not offset:
            return self.join(a, self.solve(inner, ctx))
        names = inner.vars if isinstance(inner, A.Project) else None
        body = inner.inner if isinstance(inner, A.Project) else inner
        free = Solutions(a.df.withColumn("__row", F.monotonically_increasing_id()), a.types | {"__row": INT}, a.maybe)
        both = self.join(free, self.solve(body, ctx))
        keys = self.order(order, both, ctx) or [F.lit(1)]
        w = Window.partitionBy("__row").orderBy(*keys)
        df = both.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > offset)
        if limit is not None:
            df = df.where(F.col("__n") <= offset + limit)
        keep = [n for n in both.types if n in a.types or names is None or n in names]
        keep = [n for n in keep if n != "__row"]
        return Solutions(df.select(*keep), {n: both.types[n] for n in keep}, both.maybe & set(keep))

    def _filter(self, node: A.Filter, ctx: Context) -> Solutions:
        return self._filtered(self.solve(node.inner, ctx), node.on, ctx)

    def _filtered(self, s: Solutions, on: Any, ctx: Context) -> Solutions:
        if isinstance(on, A.Call) and on.op == "&&":
            return self._filtered(self._filtered(s, on.args[0], ctx), on.args[1], ctx)
        if isinstance(on, A.Call) and on.op == "!" and isinstance(on.args[0], A.Exists):
            on = A.Exists(on.args[0].pattern, not on.args[0].positive)
        if isinstance(on, A.Exists):
            return Solutions(self._semi(s, on, ctx, "left_semi" if on.positive else "left_anti"), s.types, s.maybe)
        flags: dict[Any, str] = {}
        for e in _exists_in(on):  # under an operator: a column tells whether it holds
            self.count += 1
            flag = f"__e{self.count}"
            marked = Solutions(s.df.withColumn("__id", F.monotonically_increasing_id()), s.types | {"__id": INT}, s.maybe)
            hit = self._semi(marked, A.Exists(e.pattern, True), ctx, "left_semi").select(F.col("__id").alias("__hit")).distinct()
            df = marked.df.join(hit, F.col("__id") == F.col("__hit"), "left")
            s = Solutions(df.withColumn(flag, F.col("__hit").isNotNull()).drop("__id", "__hit"), s.types | {flag: BOOL}, s.maybe)
            flags[e] = flag
        scope = {n: s.val(n) for n in s.types}
        scope |= {e: Val(BOOL, s.df[f] if e.positive else ~s.df[f]) for e, f in flags.items()}
        df = s.df.where(V.truth(self.expression(on, scope, ctx)))
        types = {n: t for n, t in s.types.items() if n not in flags.values()}
        return Solutions(df.select(*types), types, s.maybe)

    def _semi(self, s: Solutions, e: A.Exists, ctx: Context, how: str) -> DataFrame:
        """Solutions with (or without) a compatible solution of the pattern; filters of it may use outer variables."""
        pattern, outer = e.pattern, []
        while isinstance(pattern, A.Filter):
            outer.append(pattern.on)
            pattern = pattern.inner
        inner = self.solve(pattern, ctx)
        late = [f for f in outer if not _expr_vars(f) <= set(inner.types)]
        for f in outer:
            if f not in late:
                inner = self._filtered(inner, f, ctx)
        b, shared = self._aligned(s, inner)
        cond = self._match(s, b, shared)
        scope = {n: s.val(n) for n in s.types} | {n: b.val(n) for n in b.types if n not in {m for _, m, _ in shared}}
        for f in late:
            test = V.truth(self.expression(f, scope, ctx))
            cond = test if cond is None else cond & test
        return s.df.join(b.df, F.lit(True) if cond is None else cond, how)

    def _extend(self, node: A.Extend, ctx: Context) -> Solutions:
        s = self.solve(node.inner, ctx)
        if node.var in s.types and not isinstance(node.expr, A.Var):
            raise Unsupported(f"?{node.var} is bound already")
        v = self.expression(node.expr, {n: s.val(n) for n in s.types}, ctx)
        certain = not _expr_vars(node.expr) and not isinstance(node.expr, A.Call) or isinstance(node.expr, A.Var) and node.expr.name in s.types and node.expr.name not in s.maybe
        return Solutions(s.df.withColumn(node.var, v.col), s.types | {node.var: v.type}, s.maybe | (set() if certain else {node.var}))

    def _values(self, node: A.Values, ctx: Context) -> Solutions:
        types: dict[str, Type] = {}
        for i, n in enumerate(node.vars):
            kinds = [V.constant(r[i]).type for r in node.rows if r[i] is not None]
            t = kinds[0] if kinds else TERM
            for k in kinds[1:]:
                t = V.unify(t, k)
            types[n] = t
        if not node.rows:
            return self.empty(types)
        rows = [F.struct(*[(F.lit(None).cast(SQL_TYPE[types[n].kind]) if x is None else V.convert(V.constant(x), types[n]).cast(SQL_TYPE[types[n].kind])).alias(n) for n, x in zip(node.vars, r, strict=True)]) for r in node.rows]
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return Solutions(df, types, {n for i, n in enumerate(node.vars) if any(r[i] is None for r in node.rows)})

    def _graphpattern(self, node: A.GraphPattern, ctx: Context) -> Solutions:
        if isinstance(node.name, A.Iri) and ctx.named and node.name.value not in ctx.named:
            inner = self.solve(node.inner, replace(ctx, graph=node.name))
            return Solutions(inner.df.where("false"), inner.types, inner.maybe)
        if isinstance(node.name, A.Var) and isinstance(node.inner, A.Project) and _grouped(node.inner):
            return self._group_by_graph(node, ctx)
        return self.solve(node.inner, replace(ctx, graph=node.name))

    def _group_by_graph(self, node: A.GraphPattern, ctx: Context) -> Solutions:
        """A grouped sub-query inside GRAPH ?g: one result for each graph of the registry, empty ones included."""
        parts = None
        for g in self.source.graphs():
            s = self.solve(node.inner, replace(ctx, graph=A.Iri(g)))
            s = Solutions(s.df.withColumn(node.name.name, F.lit(g)), s.types | {node.name.name: IRI}, s.maybe)
            parts = s if parts is None else self.both(parts, s)
        return parts or self.empty({node.name.name: IRI})

    def _service(self, node: A.Service, ctx: Context) -> Solutions:
        if isinstance(node.name, A.Var):
            out = None
            for url, source in self.services.items():
                s = Compiler(source, self.spark).solve(node.inner, Context())
                s = Solutions(s.df.withColumn(node.name.name, F.lit(url)), s.types | {node.name.name: IRI}, s.maybe)
                out = s if out is None else self.both(out, s)
            return out or self.empty({node.name.name: IRI})
        source = self.services.get(node.name.value)
        if source is None:
            if node.silent:
                return self.unit()
            raise Unsupported(f"no service is registered for <{node.name.value}>")
        return Compiler(source, self.spark).solve(node.inner, Context())

    def _group(self, node: A.Group, ctx: Context) -> Solutions:
        s = self.solve(node.inner, ctx)
        scope = {n: s.val(n) for n in s.types}
        keys = [(n, self.expression(e, scope, ctx)) for n, e in node.keys]
        aggs = [(n, *self.aggregate(a, s, scope, ctx)) for n, a in node.aggs]
        cols = [c.alias(f"{n}") for n, _, c in aggs] or [F.count(F.lit(1)).alias("__none")]
        keyed = s.df.groupBy(*[v.col.alias(n) for n, v in keys]) if keys else s.df.groupBy()
        df = keyed.agg(*cols)
        types = {n: v.type for n, v in keys} | {n: t for n, t, _ in aggs}
        maybe = {n for n, e in node.keys if not (isinstance(e, A.Var) and e.name in s.types and e.name not in s.maybe)}
        maybe |= {n for (n, a) in node.aggs if a.name != "count"}
        return Solutions(df.select(*types) if types else df.select(), types, maybe)

    def aggregate(self, a: A.Agg, s: Solutions, scope: dict, ctx: Context) -> tuple[Type, Column]:
        if a.arg is None:
            if a.distinct:
                return INT, F.count_distinct(F.struct(*[s.df[n] for n in s.types]))
            return INT, F.count(F.lit(1))
        v = self.expression(a.arg, scope, ctx)
        c = v.col
        if a.name == "count":
            return INT, F.count_distinct(c) if a.distinct else F.count(c)
        if a.name in ("sum", "avg"):
            if v.kind in V.NUMERIC:
                add = F.sum_distinct(c) if a.distinct else F.sum(c)
                if a.name == "sum":
                    zero = F.lit(0).cast({"int": "bigint", "dec": "decimal(38,18)", "dbl": "double"}[v.kind])
                    return v.type, F.coalesce(add, zero)
                mean = F.try_divide(add.cast("double"), (F.count_distinct(c) if a.distinct else F.count(c)).cast("double"))
                return DBL, F.coalesce(mean, F.lit(0.0))
            n = V.numeric(v)
            code = F.max(F.when(V.to_term(v)["dt"].isin(V.XSD + "double", V.XSD + "float"), 2).when(V.to_term(v)["dt"] == V.XSD + "decimal", 1).otherwise(0))
            bad = F.bool_or(c.isNotNull() & n.isNull())
            values = F.collect_set(V.to_term(v)) if a.distinct else None
            total = F.aggregate(values, F.lit(0.0), lambda x, y: x + y["lex"].try_cast("double")) if a.distinct else F.sum(n)
            size = F.size(values) if a.distinct else F.count(n)
            exact = F.sum(F.when(n.isNotNull(), V.to_term(v)["lex"].try_cast("decimal(38,18)"))) if not a.distinct else total.cast("decimal(38,18)")
            if a.name == "avg":
                total, exact, code = total / size, (exact / size).cast("decimal(38,18)"), F.greatest(code, F.lit(1))
            lex = F.when(F.coalesce(size, F.lit(0)) == 0, "0").when(code == 2, total.cast("string")).when(code == 1, _trimmed(exact)).otherwise(exact.cast("decimal(38,0)").cast("string"))
            dt = F.when(F.coalesce(size, F.lit(0)) == 0, V.XSD + "integer").when(code == 2, V.XSD + "double").when(code == 1, V.XSD + "decimal").otherwise(V.XSD + "integer")
            return TERM, F.when(~F.coalesce(bad, F.lit(False)), V.struct(2, lex, dt))
        if a.name in ("min", "max"):
            if v.kind != "term":
                return v.type, (F.min if a.name == "min" else F.max)(c)
            keyed = F.when(c.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(V.order_keys(v))], c.alias("t")))
            return TERM, (F.min if a.name == "min" else F.max)(keyed)["t"]
        if a.name == "sample":
            return v.type, F.min(c) if v.kind != "term" else F.min(c)
        if a.name == "group_concat":
            items = F.collect_set(V.lexical(v)) if a.distinct else F.collect_list(V.lexical(v))
            return STR, F.array_join(F.array_sort(items), a.sep)
        if a.name == "median":
            return DBL, F.percentile(V.numeric(v) if v.kind == "term" else c.cast("double"), 0.5)
        if a.name == "mode":
            return v.type, F.mode(c, True)
        custom = self.aggregates.get(a.name)
        if custom is None:
            raise Unsupported(f"no aggregate {a.name}")
        return custom(v)

    def _project(self, node: A.Project, ctx: Context) -> Solutions:
        s = self.solve(node.inner, ctx)
        names = node.vars if node.vars is not None else [n for n in s.types if not n.startswith("__")]
        cols = [s.df[n] if n in s.types else F.lit(None).cast("string").alias(n) for n in names]
        return Solutions(s.df.select(*cols), {n: s.types.get(n, STR) for n in names}, {n for n in names if n in s.maybe or n not in s.types})

    def _distinct(self, node: A.Distinct, ctx: Context) -> Solutions:
        inner, order = node.inner, None
        if isinstance(inner, A.Project) and isinstance(inner.inner, A.OrderBy):
            order = inner.inner.keys
            inner = A.Project(inner.inner.inner, inner.vars)
        s = self.solve(inner, ctx)
        s = Solutions(s.df.distinct(), s.types, s.maybe)
        if order:
            kept = tuple((e, asc) for e, asc in order if _expr_vars(e) <= set(s.types))
            s = Solutions(s.df.orderBy(*self.order(kept, s, ctx)), s.types, s.maybe) if kept else s
        return s

    def order(self, keys: tuple, s: Solutions, ctx: Context) -> list[Column]:
        out = []
        for e, asc in keys:
            for k in V.order_keys(self.expression(e, {n: s.val(n) for n in s.types}, ctx)):
                out.append(k.asc_nulls_first() if asc else k.desc_nulls_last())
        return out

    def _orderby(self, node: A.OrderBy, ctx: Context) -> Solutions:
        s = self.solve(node.inner, ctx)
        return Solutions(s.df.orderBy(*self.order(node.keys, s, ctx)), s.types, s.maybe)

    def _slice(self, node: A.Slice, ctx: Context) -> Solutions:
        s = self.solve(node.inner, ctx)
        df = s.df.offset(node.offset) if node.offset else s.df
        return Solutions(df.limit(node.limit) if node.limit is not None else df, s.types, s.maybe)

    # -- property paths
    def path_pattern(self, t: A.Triple, ctx: Context) -> Solutions:
        from ..operators.paths import path

        s, o = _as_var(t.s), _as_var(t.o)
        e = path(self, t.p, ctx, None if isinstance(s, A.Var) else s, None if isinstance(o, A.Var) else o)
        types = {"s": e.types["s"], "o": e.types["o"]} | ({"g": IRI} if "g" in e.types else {})
        df, names = e.df, {}
        for place, x in (("s", s), ("o", o), *((("g", ctx.graph),) if "g" in e.types else ())):
            if isinstance(x, A.Var):
                if x.name in names:
                    df = df.where(V.same_term(Val(types[names[x.name]], df[names[x.name]]), Val(types[place], df[place])))
                else:
                    names[x.name] = place
            elif x is not None:
                df = df.where(V.same_term(Val(types[place], df[place]), V.constant(x)))
        return Solutions(df.select(*[df[p].alias(n) for n, p in names.items()]), {n: types[p] for n, p in names.items()})

    # -- expressions
    def expression(self, e: Any, scope: dict, ctx: Context) -> Val:
        if isinstance(e, A.Var):
            return scope.get(e.name) or Val(STR, F.lit(None).cast("string"))
        if isinstance(e, A.Exists):
            if e in scope:
                return scope[e]
            raise Unsupported("EXISTS in this place")
        if not isinstance(e, A.Call):
            if isinstance(e, A.Quoted) and any(isinstance(x, A.Var) for x in (e.s, e.p, e.o)):
                parts = [V.shown(V.to_term(self.expression(x, scope, ctx))) for x in (e.s, e.p, e.o)]
                return Val(TERM, V.struct(5, F.concat(F.lit("<< "), F.concat_ws(" ", *parts), F.lit(" >>"))))
            return V.constant(e)
        if e.op == "bound":
            return Val(BOOL, scope[e.args[0].name].col.isNotNull() if e.args[0].name in scope else F.lit(False))
        args = [self.expression(x, scope, ctx) for x in e.args]
        op = e.op
        if op == "||":
            return Val(BOOL, V.truth(args[0]) | V.truth(args[1]))
        if op == "&&":
            return Val(BOOL, V.truth(args[0]) & V.truth(args[1]))
        if op == "!":
            return Val(BOOL, ~V.truth(args[0]))
        if op == "=":
            return Val(BOOL, V.equal(*args))
        if op == "!=":
            return Val(BOOL, ~V.equal(*args))
        if op in ("<", "<=", ">", ">="):
            return Val(BOOL, V.less(args[0], args[1], op))
        if op in ("+", "-", "*", "/"):
            return V.arithmetic(op, *args)
        if op == "neg":
            return V.arithmetic("-", Val(INT, F.lit(0).cast("bigint")), args[0])
        if op in ("in", "notin"):
            hit: Column = F.lit(False)
            for x in args[1:]:
                hit = hit | V.equal(args[0], x)
            return Val(BOOL, hit if op == "in" else ~hit)
        if op in ("if", "coalesce"):
            branches = args[1:] if op == "if" else args
            t = branches[0].type
            for b in branches[1:]:
                t = V.unify(t, b.type)
            cols = [V.convert(b, t) for b in branches]
            if op == "coalesce":
                return Val(t, F.coalesce(*cols))
            test = V.truth(args[0])
            return Val(t, F.when(test, cols[0]).when(~test, cols[1]))
        if op.endswith("/confidence") or op.endswith("/similar") or op.endswith("/temporal_window"):
            extra = getattr(self.source, op.rsplit("/", 1)[1], None)
            if extra is not None:
                return extra(args)
        f = FUNCTIONS.get(op)
        if f is None:
            raise Unsupported(f"unknown function {op}")
        return f(args)


SQL_TYPE = {"iri": "string", "str": "string", "int": "bigint", "dec": "decimal(38,18)", "dbl": "double", "bool": "boolean", "dt": "timestamp_ntz", "date": "date", "term": V.TERM_SQL, "ref": "bigint"}


def _trimmed(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), r"0+$", "")
    return F.regexp_replace(s, r"\.$", ".0")


def _as_var(x: Any) -> Any:
    return A.Var("__n_" + x.label) if isinstance(x, A.Blank) else x


_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _conjuncts(e: Any) -> list:
    return [y for x in e.args for y in _conjuncts(x)] if isinstance(e, A.Call) and e.op == "&&" else [e]


def _subjects(node: Any) -> set[str] | None:
    """The variables that are subjects in a pattern of rows; None where it is made of more than that."""
    if isinstance(node, A.Bgp):
        return None if any(isinstance(t.p, A.Path) for t in node.triples) else {n for t in node.triples for n in _vars_of(_as_var(t.s))}
    if isinstance(node, A.Filter):
        return _subjects(node.inner)
    if isinstance(node, (A.Join, A.LeftJoin)):
        left, right = _subjects(node.left), _subjects(node.right)
        return left | right if left and right else None
    return None


def _vars_of(x: Any) -> list[str]:
    if isinstance(x, A.Var):
        return [x.name]
    if isinstance(x, A.Quoted):
        return [n for y in (x.s, x.p, x.o) for n in _vars_of(y)]
    return []


def _expr_vars(e: Any) -> set[str]:
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Call):
        return {n for x in e.args for n in _expr_vars(x)}
    if isinstance(e, A.Quoted):
        return set(_vars_of(e))
    return set()


def _exists_in(e: Any) -> list[A.Exists]:
    if isinstance(e, A.Exists):
        return [e]
    return [x for y in e.args for x in _exists_in(y)] if isinstance(e, A.Call) else []


def _has_exists(e: Any) -> bool:
    return bool(_exists_in(e))


def _grouped(p: Any) -> bool:
    while p is not None and not isinstance(p, A.Group):
        p = getattr(p, "inner", None)
    return p is not None
