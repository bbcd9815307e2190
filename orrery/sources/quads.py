"""A store of quads in DataFrames: named graphs, updates, point-in-time reads, erasure, compaction and files.

Columns: s and o (term structs), p and g (IRI strings; g null in the default graph), sid (statement number, in order of
insertion) and source (0 told, 1 inferred). Updates make a new DataFrame and are written out, so that plans don't grow; as on
disk, files are partitioned by predicate.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import BOOL, DBL, IRI, TERM, Type, Val
from ..operators.lineage import written
from ..plans import algebra as A
from ..plans.compiler import Compiler, Context, Solutions
from ..plans.parser import parse_query, parse_update
from . import rdf

KEY = ["s", "p", "o", "g"]


def _null_safe(a: DataFrame, b: DataFrame) -> Column:
    return (a["s"] == b["s"]) & (a["p"] == b["p"]) & (a["o"] == b["o"]) & a["g"].eqNullSafe(b["g"])


class QuadStore:
    """A graph of quads and what can be done with it."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, prefixes: dict[str, str] | None = None):
        self.spark = spark
        self.prefixes = dict(prefixes or {})
        self.registry: set[str] = set()
        self.services: dict[str, Any] = {}
        self.aggregates: dict[str, Any] = {}
        self.confidences: DataFrame | None = None
        self.entailed: dict[str, list[str]] = {}
        self.until: int | None = None
        self.log: list[tuple[str, DataFrame]] = []  # change capture: ("insert" or "delete", quads)
        empty = spark.createDataFrame([], rdf.QUAD_SQL)
        self._quads = self._numbered(quads if quads is not None else empty, 0)
        self._issued = 0  # the largest sid ever given: those of removed quads are not given again

    # -- contents
    @property
    def quads(self) -> DataFrame:
        """All quads, or those up to the point in time that is set."""
        return self._quads if self.until is None else self._quads.where(F.col("sid") <= self.until)

    def _numbered(self, quads: DataFrame, after: int, source: int = 0) -> DataFrame:
        if "sid" in quads.columns:
            return quads
        return quads.dropDuplicates(KEY).withColumn("sid", F.monotonically_increasing_id() + after + 1).withColumn("source", F.lit(source).cast("tinyint"))

    def _last(self) -> int:
        self._issued = max(self._issued, self._quads.agg(F.max("sid")).first()[0] or 0)
        return self._issued

    def rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, rdf.QUAD_SQL)

    def add(self, quads: DataFrame, source: int = 0) -> None:
        """Inserts what isn't there yet."""
        new = quads.select(*KEY).dropDuplicates(KEY)
        new = new.join(self._quads.select(*KEY), _null_safe(new, self._quads), "left_anti")
        new = written(self._numbered(new, self._last(), source))
        self._quads = self._quads.unionByName(new)
        self.registry |= {r.g for r in new.select("g").distinct().where("g is not null").collect()}
        self.log.append(("insert", new))

    def remove(self, quads: DataFrame) -> None:
        self._last()
        gone = quads.select(*KEY).dropDuplicates(KEY)
        self.log.append(("delete", written(gone)))
        self._quads = written(self._quads.join(gone, _null_safe(self._quads, gone), "left_anti"))

    def load(self, text: str, fmt: str = "ttl", graph: str | None = None, strict: bool = False) -> None:
        parse = {"nt": rdf.parse_lines, "nq": rdf.parse_lines, "ttl": rdf.parse_turtle, "trig": rdf.parse_turtle, "rdf": rdf.parse_rdfxml, "jsonld": rdf.parse_jsonld}[fmt]
        self.add(self.rows(parse(text, graph, strict) if fmt in ("nt", "nq") else parse(text, graph)))

    def load_file(self, path: str, graph: str | None = None, fmt: str | None = None) -> None:
        self.add(rdf.read_file(self.spark, path, graph, fmt))

    def load_with_confidence(self, text: str, confidence: float, fmt: str = "ttl", graph: str | None = None, model: str = "default") -> None:
        """Loads and scores what was loaded; quads without a score count as certain."""
        self.load(text, fmt, graph)
        new = self.log[-1][1].select(*KEY).withColumn("model", F.lit(model)).withColumn("confidence", F.lit(float(confidence)))
        self.confidences = new if self.confidences is None else self.confidences.unionByName(new)

    def patch(self, text: str) -> None:
        """RDF Patch: lines ``A quad .`` and ``D quad .``."""
        lines = [x.strip() for x in text.splitlines()]
        adds = [x[2:] for x in lines if x.startswith("A ")]
        dels = [x[2:] for x in lines if x.startswith("D ")]
        if dels:
            self.remove(self.rows(rdf.parse_lines("\n".join(dels))))
        if adds:
            self.add(self.rows(rdf.parse_lines("\n".join(adds))))

    def save(self, path: str) -> None:
        self._quads.write.mode("overwrite").partitionBy("p").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> QuadStore:
        return cls(spark, spark.read.parquet(path).select(*KEY, "sid", "source"))

    def compact(self) -> None:
        """One copy of each quad, the first inserted, in few files."""
        first = self._quads.groupBy(*KEY).agg(F.min(F.struct("sid", "source")).alias("x"))
        self._quads = written(first.select(*KEY, "x.*"))

    def point_in_time(self, sid: int | None) -> None:
        self.until = sid

    def erase(self, iri: str) -> None:
        """Removes every quad that has the IRI as subject, object or in a quoted triple."""
        q, quoted = self._quads, f"<{iri}>"
        hit = lambda c: ((c["kind"] == 0) & (c["lex"] == iri)) | ((c["kind"] == 5) & F.contains(c["lex"], F.lit(quoted)))
        self.remove(q.where(hit(q["s"]) | hit(q["o"])))

    def find(self, s: Any = None, p: str | None = None, o: Any = None, g: str | None = None) -> DataFrame:
        df = self.quads
        if s is not None:
            df = df.where(df["s"] == V.to_term(V.constant(s)))
        if p is not None:
            df = df.where(df["p"] == p)
        if o is not None:
            df = df.where(df["o"] == V.to_term(V.constant(o)))
        return df if g is None else df.where(df["g"] == g)

    # -- as a source for the compiler
    def graphs(self) -> list[str]:
        return sorted(self.registry)

    def _scoped(self, ctx: Context) -> DataFrame:
        df = self.quads
        if isinstance(ctx.graph, A.Iri):
            return df.where(df["g"] == ctx.graph.value)
        if isinstance(ctx.graph, A.Var):
            df = df.where(df["g"].isNotNull())
            return df.where(df["g"].isin(list(ctx.named))) if ctx.named else df
        if ctx.default:
            return df.where(df["g"].isin(list(ctx.default))).dropDuplicates(["s", "p", "o"])
        return df

    def star(self, subject: Any, pairs: list, ctx: Context) -> list[tuple[DataFrame, dict[str, Type]]]:
        out: Solutions | None = None
        c = Compiler(self)
        for p, o in pairs:
            s = self._pattern(subject, p, o, ctx)
            out = s if out is None else c.join(out, s)
        return [(out.df, out.types)]

    def _pattern(self, s: Any, p: Any, o: Any, ctx: Context) -> Solutions:
        df = self._scoped(ctx)
        vals: dict[str, Val] = {}
        conds: list[Column] = []

        def bind(node: Any, val: Val) -> None:
            if isinstance(node, A.Quoted) and any(isinstance(x, A.Var) for x in (node.s, node.p, node.o)):
                conds.append(val.col["kind"] == 5)
                parts = F.regexp_extract_all(F.substring(val.col["lex"], F.lit(3), F.length(val.col["lex"]) - 4), F.lit(r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'), F.lit(1))
                for i, x in enumerate((node.s, node.p, node.o)):
                    bind(x, Val(TERM, rdf._term_of(F.get(parts, F.lit(i)))))
            elif isinstance(node, A.Var):
                if node.name in vals:
                    conds.append(V.same_term(vals[node.name], val))
                else:
                    vals[node.name] = val
            else:
                want = V.constant(node)
                conds.append(val.col == (V.to_term(want) if val.kind == "term" else want.col))

        bind(s, Val(TERM, df["s"]))
        if isinstance(p, A.Iri) and p.value in self.entailed:
            conds.append(df["p"].isin(self.entailed[p.value]))
        else:
            bind(p, Val(IRI, df["p"]))
        bind(o, Val(TERM, df["o"]))
        if isinstance(ctx.graph, A.Var):
            bind(ctx.graph, Val(IRI, df["g"]))
        if ctx.min_confidence is not None and self.confidences is not None:
            weak = self.confidences.groupBy(*KEY).agg(F.max("confidence").alias("c")).where(F.col("c") < ctx.min_confidence)
            df = df.join(weak, _null_safe(df, weak), "left_anti")
        for c in conds:
            df = df.where(c)
        return Solutions(df.select(*[v.col.alias(n) for n, v in vals.items()]), {n: v.type for n, v in vals.items()})

    def nodes(self, ctx: Context) -> tuple[DataFrame, Type]:
        df = self._scoped(ctx)
        extra = ["g"] if isinstance(ctx.graph, A.Var) else []
        return df.select(F.explode(F.array("s", "o")).alias("n"), *extra).distinct(), TERM

    # -- queries
    def context(self, q: Any) -> Context:
        return Context(default=tuple(q.default_graphs), named=tuple(q.named_graphs))

    def compiler(self) -> Compiler:
        return Compiler(self, self.spark, self.services, self.aggregates)

    def select(self, text: str, **options: Any) -> DataFrame:
        """The solutions; terms in N-Triples syntax, natively typed values as they are."""
        return select(self, text, self.prefixes, self.compiler(), **options)

    def ask(self, text: str) -> bool:
        q = parse_query(text, self.prefixes)
        return not self.compiler().solve(q.pattern, self.context(q)).df.isEmpty()

    def construct(self, text: str) -> DataFrame:
        """Distinct triples (s, p, o, g null) of the template; those with unbound parts are left out."""
        q = parse_query(text, self.prefixes)
        return instantiate(self.compiler().solve(q.pattern, self.context(q)), [(None, t) for t in q.template])

    def describe(self, text: str, symmetric: bool = False, depth: int = 16) -> DataFrame:
        """Concise bounded descriptions: the statements of each resource, and those of the blank nodes they lead to."""
        q = parse_query(text, self.prefixes)
        s = self.compiler().solve(q.pattern, self.context(q))
        wanted = [x for x in (s.types if q.describe == ("*",) else q.describe)]
        roots = None
        for x in wanted:
            name = x if isinstance(x, str) else getattr(x, "name", None)
            part = s.df.select(V.to_term(s.val(name)).alias("n")) if name in s.types else self.spark.range(1).select(V.to_term(V.constant(x)).alias("n"))
            roots = part if roots is None else roots.unionByName(part)
        frontier = written(roots.where("n is not null").distinct())
        quads = self.quads
        out = quads.join(frontier, quads["o"] == frontier["n"], "left_semi") if symmetric else None
        seen = frontier
        for _ in range(depth):
            part = quads.join(frontier, quads["s"] == frontier["n"], "left_semi")
            out = part if out is None else out.unionByName(part)
            nxt = part.where("o.kind = 1").select(F.col("o").alias("n")).distinct()
            frontier = written(nxt.join(seen, "n", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return out.select(*KEY).distinct()

    def explain(self, text: str) -> str:
        q = parse_query(text, self.prefixes)
        return f"{q.pattern}\n{self.compiler().solve(q.pattern, self.context(q)).df._jdf.queryExecution().toString()}"

    def confidence(self, args: list[Val]) -> Val:
        """The highest confidence of statements with the given subject, predicate and object; 1 where none is scored."""
        if self.confidences is None:
            return Val(DBL, F.lit(1.0))
        rows = self.confidences.groupBy("s", "p", "o").agg(F.max("confidence").alias("c")).select(F.md5(F.concat_ws("\t", V.shown(F.col("s")), "p", V.shown(F.col("o")))).alias("k"), "c")
        if rows.count() > 100_000:
            raise ValueError("too many scored statements for an expression; join with confidences instead")
        table = F.create_map(*[x for r in rows.collect() for x in (F.lit(r.k), F.lit(r.c))])
        key = F.md5(F.concat_ws("\t", V.shown(V.to_term(args[0])), V.lexical(args[1]), V.shown(V.to_term(args[2]))))
        return Val(DBL, F.coalesce(F.try_element_at(table, key), F.lit(1.0)))

    # -- updates
    def update(self, text: str) -> None:
        """Runs the operations in order; each sees what those before it did."""
        for u in parse_update(text, self.prefixes):
            getattr(self, "_" + u.op)(u)

    def _data(self, quads: tuple, graph: Any = None) -> DataFrame:
        return self.rows([rdf.row(t.s, t.p, t.o, g.value if g is not None else graph.value if graph is not None else None) for g, t in quads])

    def _insert_data(self, u: A.Update) -> None:
        self.add(self._data(u.insert))

    def _delete_data(self, u: A.Update) -> None:
        self.remove(self._data(u.delete))

    def _modify(self, u: A.Update) -> None:
        """All deletes, then all inserts, for the solutions as they are before."""
        ctx = Context(default=tuple(u.using), named=tuple(u.using_named)) if u.using or u.using_named else Context(default=(u.graph.value,)) if u.graph is not None else Context()
        s = self.compiler().solve(u.pattern, ctx)
        s = Solutions(written(s.df) if s.types else s.df, s.types, s.maybe)
        graph = u.graph.value if u.graph is not None else None
        if u.delete:
            gone = written(instantiate(s, u.delete, graph))
            everywhere = [t for g, t in u.delete if g is None and graph is None]
            if everywhere:  # without a graph named, a plain pattern matches all graphs: delete where it was found
                hit = gone.where("g is null")
                q = self._quads
                gone = gone.unionByName(q.join(hit, (q["s"] == hit["s"]) & (q["p"] == hit["p"]) & (q["o"] == hit["o"]), "left_semi").select(*KEY))
            inserted = written(instantiate(s, u.insert, graph)) if u.insert else None
            self.remove(gone)
        else:
            inserted = instantiate(s, u.insert, graph)
        if inserted is not None:
            self.add(inserted)

    def _where(self, target: Any) -> Column:
        if target == "all":
            return F.lit(True)
        return F.col("g").isNull() if target == "default" else F.col("g").isNotNull() if target == "named" else F.col("g") == target.value

    def _clear(self, u: A.Update) -> None:
        self.remove(self._quads.where(self._where(u.target)))

    def _drop(self, u: A.Update) -> None:
        self._clear(u)
        if u.target in ("all", "named"):
            self.registry.clear()
        elif isinstance(u.target, A.Iri):
            self.registry.discard(u.target.value)

    def _create(self, u: A.Update) -> None:
        self.registry.add(u.target.value)

    def _moved(self, u: A.Update) -> DataFrame:
        to = F.lit(None).cast("string") if u.target == "default" else F.lit(u.target.value)
        return written(self._quads.where(self._where(u.source)).withColumn("g", to))

    def _add(self, u: A.Update) -> None:
        if u.source != u.target:
            self.add(self._moved(u))

    def _copy(self, u: A.Update) -> None:
        if u.source != u.target:
            new = self._moved(u)
            self._clear(u)
            self.add(new)

    def _move(self, u: A.Update) -> None:
        if u.source != u.target:
            self._copy(u)
            self._drop(A.Update("drop", target=u.source))

    def _load(self, u: A.Update) -> None:
        try:
            self.load_file(u.source.value.removeprefix("file://"), None if u.target == "default" else u.target.value)
        except Exception:
            if not u.silent:
                raise


def instantiate(s: Solutions, quads: Any, graph: str | None = None) -> DataFrame:
    """Distinct quads of a template for each solution."""
    parts = []
    salt = F.monotonically_increasing_id() if any(isinstance(x, (A.Blank,)) or isinstance(x, A.Var) and x.name.startswith("__") for _, t in quads for x in (t.s, t.o)) else F.lit(0)

    def of(x: Any) -> Val:
        if isinstance(x, A.Var):
            if x.name in s.types:
                return s.val(x.name)
            if x.name.startswith("__"):
                return Val(TERM, V.struct(1, F.concat(F.lit(x.name.strip("_") + "_"), salt.cast("string"))))
            return Val(TERM, F.lit(None).cast(V.TERM_SQL))
        if isinstance(x, A.Blank):
            return Val(TERM, V.struct(1, F.concat(F.lit(x.label + "_"), salt.cast("string"))))
        if isinstance(x, A.Quoted):
            inner = [V.shown(V.to_term(of(y))) for y in (x.s, x.p, x.o)]
            return Val(TERM, V.struct(5, F.concat(F.lit("<< "), F.concat_ws(" ", *inner), F.lit(" >>"))))
        return V.constant(x)

    for g, t in quads:
        where = F.lit(graph) if g is None else V.lexical(of(g))
        parts.append(F.struct(V.to_term(of(t.s)).alias("s"), V.lexical(of(t.p)).alias("p"), V.to_term(of(t.o)).alias("o"), where.cast("string").alias("g")))
    out = s.df.select(F.explode(F.array(*parts)).alias("q")).select("q.*")
    return out.where("s is not null and p is not null and o is not null and s.kind <> 2").distinct()


def select(source: Any, text: str, prefixes: dict[str, str] | None = None, compiler: Compiler | None = None, *, max_depth: int = 100, min_confidence: float | None = None, max_rows: int | None = None) -> DataFrame:
    """Runs a SELECT over any source. References become IRI strings, generic terms N-Triples text."""
    q = parse_query(text, prefixes)
    s = (compiler or Compiler(source)).solve(q.pattern, Context(default=tuple(q.default_graphs), named=tuple(q.named_graphs), max_depth=max_depth, min_confidence=min_confidence))
    out = s.df.select(*[(V.shown(s.df[n]) if t.kind == "term" else V.iri_text(s.val(n)) if t.kind == "ref" else s.df[n]).alias(n) for n, t in s.types.items()])
    if max_rows is not None and out.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return out


def ask(source: Any, text: str, prefixes: dict[str, str] | None = None) -> bool:
    q = parse_query(text, prefixes)
    return not Compiler(source).solve(q.pattern, Context(default=tuple(q.default_graphs), named=tuple(q.named_graphs))).df.isEmpty()


__all__ = ["QuadStore", "select", "ask", "instantiate", "BOOL"]
