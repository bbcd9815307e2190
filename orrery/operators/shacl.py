"""SHACL validation, a whole shape at a time: each constraint is one DataFrame of violations.

Shapes are read from Turtle. A violation row is (shape, focus, path, constraint, value). Data are quads (s, p, o, g).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import TERM, Val
from ..plans import algebra as A
from ..plans.compiler import Compiler, Context
from ..sources.quads import QuadStore
from ..sources.rdf import parse_turtle
from .lineage import written

SH = A.SH
_LISTS = ("in", "languageIn", "and", "or", "xone", "ignoredProperties")


@dataclass
class Shape:
    id: str
    targets: list[tuple[str, str]] = field(default_factory=list)  # (class, node, subjectsOf, objectsOf), IRI
    path: Any = None
    constraints: list[tuple[str, Any]] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)
    severity: float = 1.0
    closed: bool = False
    ignored: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)


def parse_shapes(text: str) -> dict[str, Shape]:
    rows = parse_turtle(text)
    by: dict[str, list[tuple[str, tuple]]] = {}
    for s, p, o, _ in rows:
        by.setdefault(s[1], []).append((p, o))
    first = {s: o for s, ps in by.items() for p, o in ps if p == A.RDF + "first"}
    rest = {s: o[1] for s, ps in by.items() for p, o in ps if p == A.RDF + "rest"}

    def items(node: str) -> list[tuple]:
        out = []
        while node in first:
            out.append(first[node])
            node = rest[node]
        return out

    def path(o: tuple) -> Any:
        if o[0] == 0:
            return A.Iri(o[1])
        if o[1] in first:
            return A.Path("seq", tuple(path(x) for x in items(o[1])))
        for p, x in by.get(o[1], []):
            kind = p.removeprefix(SH)
            if kind == "inversePath":
                return A.Path("inv", (path(x),))
            if kind == "alternativePath":
                return A.Path("alt", tuple(path(y) for y in items(x[1])))
            if kind in ("zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath"):
                return A.Path({"z": "star", "o": "plus"}.get(kind[0], "") if kind != "zeroOrOnePath" else "opt", (path(x),))
        raise ValueError(f"not a path: {o}")

    shapes: dict[str, Shape] = {}
    for s, ps in by.items():
        if not any(p.startswith(SH) for p, _ in ps):
            continue
        sh = shapes.setdefault(s, Shape(s))
        for p, o in ps:
            k = p.removeprefix(SH)
            if k in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf"):
                sh.targets.append((k.removeprefix("target"), o[1]))
            elif k == "path":
                sh.path = path(o)
            elif k == "property":
                sh.properties.append(o[1])
            elif k == "closed":
                sh.closed = o[1] in ("true", "1")
            elif k == "ignoredProperties":
                sh.ignored = [x[1] for x in items(o[1])]
            elif k == "severityWeight":
                sh.severity = float(o[1])
            elif k == "rule":
                sh.rules += [x[1] for q, x in by.get(o[1], []) if q == SH + "construct"]
            elif k == "sparql":
                sh.constraints += [("sparql", x[1]) for q, x in by.get(o[1], []) if q == SH + "select"]
            elif k in _LISTS:
                sh.constraints.append((k, items(o[1])))
            elif p.startswith(SH) and k not in ("name", "description", "message", "severity", "flags", "qualifiedMinCount", "qualifiedMaxCount", "order", "select"):
                if k == "pattern":
                    sh.constraints.append((k, (o[1], next((x[1] for q, x in ps if q == SH + "flags"), ""))))
                elif k == "qualifiedValueShape":
                    bound = lambda n, ps=ps: next((int(x[1]) for q, x in ps if q == SH + n), None)
                    sh.constraints.append((k, (o[1], bound("qualifiedMinCount"), bound("qualifiedMaxCount"))))
                else:
                    sh.constraints.append((k, o))
        if any(p == A.RDF + "type" and o[1] in (A.RDFS + "Class", A.OWL + "Class") for p, o in ps):
            sh.targets.append(("Class", s))
    return shapes


_COLS = ["shape", "focus", "path", "constraint", "value"]


class Validator:
    def __init__(self, store: QuadStore, shapes: dict[str, Shape], graph: str | None = None):
        self.spark: SparkSession = store.spark
        self.store, self.shapes = store, shapes
        self.context = Context(graph=A.Iri(graph)) if graph else Context()
        df = store.quads
        self.quads = df.where(df["g"] == graph) if graph else df

    def focus(self, shape: Shape) -> DataFrame:
        """Distinct focus nodes (f)."""
        parts = []
        for kind, iri in shape.targets:
            q = self.quads
            if kind == "Class":
                parts.append(self._instances(iri).select(F.col("s").alias("f")))
            elif kind == "Node":
                parts.append(self.spark.range(1).select(V.struct(0, F.lit(iri)).alias("f")))
            else:
                parts.append(q.where(q["p"] == iri).select(F.col("s" if kind == "SubjectsOf" else "o").alias("f")))
        if not parts:
            return self.spark.range(0).select(F.lit(None).cast(V.TERM_SQL).alias("f"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def _instances(self, iri: str) -> DataFrame:
        """Subjects (s) of the types iri and its subclasses at any depth."""
        from .paths import transitive

        q = self.quads
        edges = q.where(q["p"] == A.RDFS + "subClassOf").select(q["s"]["lex"].alias("s"), q["o"]["lex"].alias("o"))
        known = transitive(edges, end=F.lit(iri), max_depth=0).select(F.col("s").alias("c"))
        known = known.unionByName(self.spark.range(1).select(F.lit(iri).alias("c"))).distinct()
        typed = q.where(q["p"] == A.RDF + "type").select("s", q["o"]["lex"].alias("c"))
        return typed.join(known, "c", "left_semi").select("s")

    def values(self, path: Any, focus: DataFrame) -> DataFrame:
        """(f, v) of the path's distinct values."""
        if path is None:
            return focus.select("f", F.col("f").alias("v"))
        if isinstance(path, A.Iri):
            q = self.quads.where(F.col("p") == path.value).select(F.col("s").alias("f"), F.col("o").alias("v")).distinct()
            return q.join(focus, "f", "left_semi")
        from .paths import path as compiled

        s = compiled(Compiler(self.store), path, self.context)
        pairs = s.df.select(V.to_term(s.val("s")).alias("f"), V.to_term(s.val("o")).alias("v")).distinct()
        return pairs.join(focus, "f", "left_semi")

    def report(self) -> DataFrame:
        """All violations of all shapes with targets."""
        parts = [v for s in self.shapes.values() if s.targets for v in self.check(s, written(self.focus(s)))]
        return self._all(parts)

    def _all(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], "shape string, focus string, path string, constraint string, value string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def conforms(self) -> bool:
        return self.report().isEmpty()

    def check(self, shape: Shape, focus: DataFrame) -> list[DataFrame]:
        out = []
        values = self.values(shape.path, focus)
        label = _path_text(shape.path)

        def bad(rows: DataFrame, what: str, value: Any = None) -> None:
            v = V.shown(F.col("v")) if value is None and "v" in rows.columns else value if value is not None else F.lit(None).cast("string")
            out.append(rows.select(F.lit(shape.id).alias("shape"), V.shown(F.col("f")).alias("focus"), F.lit(label).alias("path"), F.lit(what).alias("constraint"), v.alias("value")))

        for kind, arg in shape.constraints:
            self._constraint(shape, kind, arg, focus, values, bad)
        for pid in shape.properties:
            inner = self.shapes[pid]
            out += self.check(inner, values.select(F.col("v").alias("f")).distinct() if shape.path is not None else focus)
        if shape.closed:
            allowed = [self.shapes[p].path.value for p in shape.properties if isinstance(self.shapes[p].path, A.Iri)] + shape.ignored
            q = self.quads.where(~F.col("p").isin(allowed)).select(F.col("s").alias("f"), F.col("p").alias("pp"), F.col("o").alias("v")).join(focus, "f", "left_semi")
            bad(q, "closed", F.concat(F.col("pp"), F.lit(" "), V.shown(F.col("v"))))
        return out

    def conforming(self, shape_id: str, nodes: DataFrame) -> DataFrame:
        """Those of nodes (f) that have no violation of the shape."""
        broken = self._all(self.check(self.shapes[shape_id], nodes)) if shape_id in self.shapes else self._all([])
        keys = nodes.withColumn("__k", V.shown(F.col("f")))
        # a nested property shape reports its own focus, so failing is told by the nodes that lead there
        direct = broken.select(F.col("focus").alias("__k")).distinct()
        return keys.join(direct, "__k", "left_anti").select("f")

    def _constraint(self, shape: Shape, kind: str, arg: Any, focus: DataFrame, values: DataFrame, bad: Any) -> None:
        v = F.col("v")
        iri = arg[1] if isinstance(arg, tuple) else None
        if kind in ("minCount", "maxCount"):
            n = focus.join(values, "f", "left").groupBy("f").agg(F.count("v").alias("n"))
            bad(n.where(F.col("n") < int(iri) if kind == "minCount" else F.col("n") > int(iri)), kind, F.col("n").cast("string"))
        elif kind == "datatype":
            ok = (v["kind"] == 2) & (v["dt"] == iri)
            cast = {"integer": "bigint", "decimal": "decimal(38,18)", "double": "double", "date": "date", "dateTime": "timestamp"}.get(iri.removeprefix(A.XSD))
            bad(values.where(~(ok & v["lex"].try_cast(cast).isNotNull() if cast else ok)), kind)
        elif kind == "class":
            typed = self._instances(iri).select(F.col("s").alias("v"))
            bad(values.join(typed, "v", "left_anti"), kind)
        elif kind == "nodeKind":
            kinds = {"IRI": [0], "BlankNode": [1], "Literal": [2], "BlankNodeOrIRI": [0, 1], "BlankNodeOrLiteral": [1, 2], "IRIOrLiteral": [0, 2]}[iri.removeprefix(SH)]
            bad(values.where(~v["kind"].isin(kinds)), kind)
        elif kind == "pattern":
            bad(values.where((v["kind"] == 1) | ~v["lex"].rlike((f"(?{arg[1]})" if arg[1] else "") + arg[0])), kind)
        elif kind in ("minLength", "maxLength"):
            n = F.length(v["lex"])
            bad(values.where((v["kind"] == 1) | (n < int(iri) if kind == "minLength" else n > int(iri))), kind)
        elif kind == "languageIn":
            tags = [x[1].lower() for x in arg]
            match = F.lit(False)
            for t in tags:
                match = match | (v["lang"] == t) | v["lang"].startswith(t + "-")
            bad(values.where(~match), kind)
        elif kind == "uniqueLang":
            if iri in ("true", "1"):
                bad(values.where(v["lang"] != "").groupBy("f", v["lang"].alias("l")).count().where("count > 1"), kind, F.col("l"))
        elif kind == "in":
            terms = [V.struct(k, F.lit(x), dt, lang) for k, x, dt, lang in arg]
            bad(values.where(~v.isin(terms)) if terms else values, kind)
        elif kind == "hasValue":
            hit = values.where(v == V.struct(arg[0], F.lit(arg[1]), arg[2], arg[3])).select("f")
            bad(focus.join(hit, "f", "left_anti"), kind)
        elif kind in ("minExclusive", "maxExclusive", "minInclusive", "maxInclusive"):
            op = {"minE": ">", "maxE": "<", "minI": ">=", "maxI": "<="}[kind[:4]]
            bound = V.constant(A.Literal(arg[1], arg[2], arg[3] or None))
            bad(values.where(~F.coalesce(V.less(Val(TERM, v), bound, op), F.lit(False))), kind)
        elif kind in ("lessThan", "lessThanOrEquals", "greaterThan"):
            other = self.values(A.Iri(iri), focus).withColumnRenamed("v", "w")
            op = {"lessThan": "<", "lessThanOrEquals": "<=", "greaterThan": ">"}[kind]
            both = values.join(other, "f")
            bad(both.where(~F.coalesce(V.less(Val(TERM, F.col("v")), Val(TERM, F.col("w")), op), F.lit(False))), kind)
        elif kind == "equals":
            other = self.values(A.Iri(iri), focus)
            bad(values.join(other, ["f", "v"], "left_anti").unionByName(other.join(values, ["f", "v"], "left_anti")), kind)
        elif kind == "disjoint":
            bad(values.join(self.values(A.Iri(iri), focus), ["f", "v"], "left_semi"), kind)
        elif kind in ("node", "not", "and", "or", "xone"):
            ids = [iri] if kind in ("node", "not") else [x[1] for x in arg]
            nodes = written(values.select(F.col("v").alias("f")).distinct())
            n: DataFrame = nodes.select(F.col("f").alias("v"), F.lit(0).alias("n")).where("false")
            for i in ids:
                n = n.unionByName(self.conforming(i, nodes).select(F.col("f").alias("v"), F.lit(1).alias("n")))
            n = n.groupBy("v").agg(F.sum("n").alias("n"))
            counted = values.join(n, "v", "left").fillna(0, ["n"])
            wrong = {"node": "n < 1", "not": "n > 0", "and": f"n < {len(ids)}", "or": "n < 1", "xone": "n <> 1"}[kind]
            bad(counted.where(wrong), kind)
        elif kind == "qualifiedValueShape":
            sid, low, high = arg
            ok = self.conforming(sid, values.select(F.col("v").alias("f")).distinct()).withColumnRenamed("f", "v")
            n = focus.join(values.join(ok, "v", "left_semi"), "f", "left").groupBy("f").agg(F.count("v").alias("n"))
            cond = F.lit(False)
            if low is not None:
                cond = cond | (F.col("n") < low)
            if high is not None:
                cond = cond | (F.col("n") > high)
            bad(n.where(cond), kind, F.col("n").cast("string"))
        elif kind == "sparql":
            found = self.store.compiler()
            from ..plans.parser import parse_query

            s = found.solve(parse_query(arg.replace("$this", "?this"), self.store.prefixes).pattern, self.context)
            rows = s.df.select(V.to_term(s.val("this")).alias("f"), (V.to_term(s.val("value")) if "value" in s.types else V.to_term(s.val("this"))).alias("v")).distinct()
            bad(rows.join(focus, "f", "left_semi"), kind)
        elif kind == "validFor":
            pass  # about temporal facts: see operators.temporal.longer_than
        elif kind not in ("path", "deactivated"):
            raise ValueError(f"unknown constraint sh:{kind}")

    def apply_rules(self, rounds: int = 20) -> int:
        """Adds what the shapes' SPARQL rules construct, until nothing is new; the number of rounds."""
        for i in range(rounds):
            before = self.store.quads.count()
            for s in self.shapes.values():
                for r in s.rules:
                    self.store.add(self.store.construct(r.replace("$this", "?this")), source=1)
            if self.store.quads.count() == before:
                return i
        raise ValueError(f"rules still add facts after {rounds} rounds")

    def score(self) -> float:
        """1 less the weighted share of violations: 1 - sum(w v) / sum(w (v + 1)) over violated shapes."""
        weight = {s.id: s.severity for s in self.shapes.values()}
        n = {r["shape"]: r["count"] for r in self.report().groupBy("shape").count().collect()}
        return 1.0 if not n else 1 - sum(weight.get(s, 1.0) * v for s, v in n.items()) / sum(weight.get(s, 1.0) * (v + 1) for s, v in n.items())


def _path_text(p: Any) -> str:
    if p is None:
        return ""
    if isinstance(p, A.Iri):
        return p.value
    inner = [_path_text(x) for x in p.args]
    return {"inv": "^{0}", "star": "({0})*", "plus": "({0})+", "opt": "({0})?"}.get(p.op, "").format(*inner) or {"seq": "/", "alt": "|"}[p.op].join(inner)
