"""Property paths. Steps are joins and unions; closures are rounds over a frontier that is anti-joined with what is known.

A bound start is pushed into the first round; if only the end is bound, the path is walked backwards from it. Inside
``GRAPH ?g`` all steps stay in one graph. Rounds are written to the shared folder, so that lineage doesn't grow.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import TERM, Val
from ..plans import algebra as A
from .lineage import written


def path(c: Any, p: Any, ctx: Any, start: Any = None, end: Any = None) -> Any:
    """Solutions with the columns s and o (and g inside GRAPH ?g)."""
    by_graph = isinstance(ctx.graph, A.Var)
    keep = ["s", "o"] + ["g"] * by_graph
    if isinstance(p, A.Iri):
        triple = A.Triple(start or A.Var("s"), p, end or A.Var("o"))
        out = _named(c.star(triple.s, [(triple.p, triple.o)], ctx), c, ctx, start, end)
        return out
    if p.op == "inv":
        e = path(c, p.args[0], ctx, end, start)
        return _solutions(c, e.df.select(e.df["o"].alias("s"), e.df["s"].alias("o"), *keep[2:]), {"s": e.types["o"], "o": e.types["s"]}, e)
    if p.op == "seq":
        out = path(c, p.args[0], ctx, start, None)
        for i, q in enumerate(p.args[1:], 2):
            nxt = path(c, q, ctx, None, end if i == len(p.args) else None)
            left = _renamed(c, out, {"s": "s", "o": "m"})
            both = c.join(left, _renamed(c, nxt, {"s": "m", "o": "o"}))
            out = _solutions(c, both.df.select("s", "o", *keep[2:]), {n: both.types[n] for n in ("s", "o")}, both)
        return out
    if p.op == "alt":
        out = path(c, p.args[0], ctx, start, end)
        for q in p.args[1:]:
            out = c.both(out, path(c, q, ctx, start, end))
        return out
    if p.op == "not":
        fwd, back = p.args
        parts = []
        if fwd or not back:
            parts.append(_negated(c, fwd, ctx, start, end, False))
        if back:
            parts.append(_negated(c, back, ctx, end, start, True))
        return parts[0] if len(parts) == 1 else c.both(*parts)
    if p.op == "opt":
        edges = path(c, p.args[0], ctx, start, end)
        both = c.both(edges, _identity(c, ctx, start, end, edges))
        return type(both)(both.df.distinct(), both.types, both.maybe)
    closed = closure(c, p.args[0], ctx, start, end)
    if p.op == "star":
        closed = c.both(closed, _identity(c, ctx, start, end, closed))
        closed = type(closed)(closed.df.distinct(), closed.types, closed.maybe)
    return closed


def _solutions(c: Any, df: Any, types: dict, like: Any) -> Any:
    types = dict(types) | ({"g": like.types["g"]} if "g" in like.types else {})
    return type(like)(df.select(*types), types)


def _renamed(c: Any, s: Any, names: dict[str, str]) -> Any:
    names = names | ({"g": "g"} if "g" in s.types else {})
    return type(s)(s.df.select(*[s.df[a].alias(b) for a, b in names.items()]), {b: s.types[a] for a, b in names.items()})


def _named(s: Any, c: Any, ctx: Any, start: Any, end: Any) -> Any:
    """The solutions of one edge pattern with constants put back as columns."""
    df, types = s.df, dict(s.types)
    for name, x in (("s", start), ("o", end)):
        if x is not None and not isinstance(x, A.Var):
            v = V.constant(x)
            df, types[name] = df.withColumn(name, v.col), v.type
    if isinstance(ctx.graph, A.Var):
        df, types["g"] = df.withColumnRenamed(ctx.graph.name, "g"), types.pop(ctx.graph.name)
    names = ["s", "o"] + ["g"] * isinstance(ctx.graph, A.Var)
    return type(s)(df.select(*names), {n: types[n] for n in names})


def _negated(c: Any, banned: tuple, ctx: Any, start: Any, end: Any, flip: bool) -> Any:
    s = c.star(start or A.Var("s"), [(A.Var("__p"), end or A.Var("o"))], ctx)
    if banned:
        kept = ~V.iri_text(s.val("__p")).isin(list(banned)) if s.types["__p"].kind != "term" else ~s.df["__p"]["lex"].isin(list(banned))
        s = type(s)(s.df.where(kept), s.types)
    e = _named(s, c, ctx, start, end)
    return e if not flip else _solutions(c, e.df.select(e.df["o"].alias("s"), e.df["s"].alias("o"), *(["g"] if "g" in e.types else [])), {"s": e.types["o"], "o": e.types["s"]}, e)


def _identity(c: Any, ctx: Any, start: Any, end: Any, like: Any) -> Any:
    known = start if start is not None else end
    if known is not None and not isinstance(ctx.graph, A.Var):
        v = V.constant(known)
        df = c.spark.range(1).select(v.col.alias("s"), v.col.alias("o"))
        return type(like)(df, {"s": v.type, "o": v.type})
    nodes, t = c.source.nodes(ctx)
    extra = ["g"] if "g" in nodes.columns else []
    df = nodes.select(F.col("n").alias("s"), F.col("n").alias("o"), *extra)
    return type(like)(df, {"s": t, "o": t} | ({"g": V.IRI} if extra else {}))


def closure(c: Any, step: Any, ctx: Any, start: Any = None, end: Any = None) -> Any:
    """Distinct pairs joined by one or more steps."""
    edges = path(c, step, ctx, None, None)
    t = V.unify(edges.types["s"], edges.types["o"])
    g = ["g"] if "g" in edges.types else []
    flat = edges.df.select(V.convert(Val(edges.types["s"], edges.df["s"]), t).alias("s"), V.convert(Val(edges.types["o"], edges.df["o"]), t).alias("o"), *g)
    pairs = transitive(flat.where("s is not null and o is not null"), start=None if start is None else _as(start, t), end=None if end is None else _as(end, t), by=g, max_depth=ctx.max_depth)
    return type(edges)(pairs.select("s", "o", *g), {"s": t, "o": t} | ({"g": V.IRI} if g else {}))


def _as(x: Any, t: Any) -> Any:
    v = V.constant(x)
    return V.convert(v, t) if t.kind != "ref" else F.lit(x.value[len(t.prefix) :]).try_cast("bigint") if x.value.startswith(t.prefix) else F.lit(None).cast("bigint")


def transitive(edges: Any, *, start: Any = None, end: Any = None, by: list[str] | None = None, max_depth: int = 100, depths: bool = False) -> Any:
    """Transitive closure of edges (s, o), from a start or to an end if given; with ``depths`` the least number of steps.

    Semi-naive: only pairs found in the last round are extended. max_depth 0 means no limit.
    """
    by = by or []
    edges = written(edges.distinct())
    backwards = end is not None and start is None
    frontier = edges
    if start is not None:
        frontier = frontier.where(frontier["s"] == start)
    elif backwards:
        frontier = frontier.where(frontier["o"] == end)
    frontier = frontier.withColumn("depth", F.lit(1))
    known = frontier = written(frontier)
    depth = 1
    while not frontier.isEmpty() and (max_depth == 0 or depth < max_depth):
        depth += 1
        if backwards:
            nxt = frontier.select(F.col("s").alias("m"), "o", *by).join(edges.select("s", F.col("o").alias("m"), *by), ["m", *by])
        else:
            nxt = frontier.select("s", F.col("o").alias("m"), *by).join(edges.select(F.col("s").alias("m"), "o", *by), ["m", *by])
        new = nxt.select("s", "o", *by).distinct().join(known.select("s", "o", *by), ["s", "o", *by], "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)))
        known = known.unionByName(frontier)
    if start is not None and end is not None:
        known = known.where(known["o"] == end)
    return known if depths else known.drop("depth")


__all__ = ["closure", "path", "transitive", "TERM"]
