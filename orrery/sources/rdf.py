"""RDF text formats: N-Triples, N-Quads, Turtle, TriG, RDF/XML, JSON-LD (expanded form) and plain JSON; readers and writers.

Line formats are parsed in Arrow-free Spark SQL expressions, line by line, on the executors. Turtle, TriG and RDF/XML files
are documents: each file is parsed as a whole by one task, many files in parallel.
"""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans import algebra as A
from ..plans.parser import Parser, SparqlError

QUAD_SQL = f"s {V.TERM_SQL}, p string, o {V.TERM_SQL}, g string"


class RdfError(ValueError):
    """The text isn't valid in its format."""


def row(s: Any, p: Any, o: Any, g: str | None = None) -> tuple:
    return (_plain(s), p.value, _plain(o), g)


def _plain(t: Any) -> tuple:
    if isinstance(t, A.Iri):
        return (0, t.value, "", "")
    if isinstance(t, (A.Blank, A.Var)):
        return (1, t.label if isinstance(t, A.Blank) else t.name.lstrip("_"), "", "")
    if isinstance(t, A.Quoted):
        return (5, V.ntriples(t), "", "")
    return (2, t.lex, t.dt, t.lang or "")


class TurtleParser(Parser):
    """Turtle and TriG, with the tokens of the query language."""

    def document(self, graph: str | None = None) -> Iterator[tuple]:
        while self.kind != "end":
            if self.kind == "lang" and self.text in ("@prefix", "@base"):
                which = self.next()
                if which == "@prefix":
                    name = self.next()
                    self.prefixes[name[:-1]] = self.iri_text(self.next())
                else:
                    self.base = self.iri_text(self.next())
                self.take(".")
            elif self.word("prefix", "base"):
                self.prologue()
            elif self.taken("graph") or (self.kind in ("iri", "pname", "bnode") and self.toks[self.i + 1][1] == "{"):
                name = self.term()
                yield from (row(t.s, t.p, t.o, getattr(name, "value", None) or "_:" + name.label) for t in self.template())
            elif self.op("{"):
                yield from (row(t.s, t.p, t.o, graph) for t in self.template())
            else:
                yield from (row(t.s, t.p, t.o, graph) for t in self.triples())

    def path(self) -> Any:  # a predicate is an IRI here
        return self.iri_or_a()


def parse_turtle(text: str, graph: str | None = None, base: str = "") -> list[tuple]:
    """Quads of a Turtle or TriG document; blank nodes are local to it."""
    p = TurtleParser(text, base=base)
    scope = uuid.uuid5(uuid.NAMESPACE_URL, text).hex[:8]
    return [_scoped(q, scope) for q in p.document(graph)]


def _scoped(q: tuple, scope: str) -> tuple:
    blank = lambda t: (1, f"{scope}_{t[1]}", "", "") if t[0] == 1 else t
    return (blank(q[0]), q[1], blank(q[2]), q[3])


def parse_lines(text: str, graph: str | None = None, strict: bool = False) -> list[tuple]:
    """Quads of N-Triples or N-Quads lines; with ``strict`` a bad line is an error, else it is skipped."""
    out = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            p = TurtleParser(line)
            s, pr, o = p.term(), p.iri(), p.term()
            g = None if p.op(".") else p.term()
            p.need(".")
        except SparqlError as e:
            if strict:
                raise RdfError(str(e)) from e
            continue
        out.append(row(s, pr, o, graph if g is None else getattr(g, "value", None) or "_:" + g.label))
    return out


def parse_rdfxml(text: str, graph: str | None = None) -> list[tuple]:
    """Quads of an RDF/XML document."""
    rdf = "{" + A.RDF + "}"
    scope = uuid.uuid5(uuid.NAMESPACE_URL, text).hex[:8]
    out: list[tuple] = []
    fresh = iter(range(1 << 60))
    name = lambda tag: tag[1:].replace("}", "", 1)
    lang_key = "{http://www.w3.org/XML/1998/namespace}lang"

    def node(e: ET.Element, lang: str | None) -> Any:
        lang = e.get(lang_key, lang)
        if e.get(rdf + "about") is not None:
            s: Any = A.Iri(e.get(rdf + "about"))
        elif e.get(rdf + "ID") is not None:
            s = A.Iri("#" + e.get(rdf + "ID"))
        else:
            s = A.Blank(f"{scope}_{e.get(rdf + 'nodeID') or next(fresh)}")
        if e.tag != rdf + "Description":
            out.append(row(s, A.Iri(A.RDF + "type"), A.Iri(name(e.tag)), graph))
        for k, v in e.attrib.items():
            if not k.startswith(rdf) and k != lang_key and k.startswith("{"):
                out.append(row(s, A.Iri(name(k)), A.Literal(v), graph))
        n = 0
        for c in e:
            tag = name(c.tag)
            if c.tag == rdf + "li":
                n += 1
                tag = f"{A.RDF}_{n}"
            out.append(row(s, A.Iri(tag), value(c, c.get(lang_key, lang)), graph))
        return s

    def value(c: ET.Element, lang: str | None) -> Any:
        if c.get(rdf + "resource") is not None:
            return A.Iri(c.get(rdf + "resource"))
        if c.get(rdf + "nodeID") is not None:
            return A.Blank(f"{scope}_{c.get(rdf + 'nodeID')}")
        kind = c.get(rdf + "parseType")
        if kind == "Resource":
            inner = ET.Element(rdf + "Description")
            inner.extend(list(c))
            return node(inner, lang)
        if kind == "Collection":
            head: Any = A.Iri(A.RDF + "nil")
            for x in reversed([node(k, lang) for k in c]):
                b = A.Blank(f"{scope}_{next(fresh)}")
                out.append(row(b, A.Iri(A.RDF + "first"), x, graph))
                out.append(row(b, A.Iri(A.RDF + "rest"), head, graph))
                head = b
            return head
        if len(c):
            return node(c[0], lang)
        text = c.text or ""
        dt = c.get(rdf + "datatype")
        return A.Literal(text, dt) if dt else A.Literal(text, A.RDF + "langString", lang.lower()) if lang else A.Literal(text)

    root = ET.fromstring(text)
    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, root.get(lang_key))
    return out


def parse_jsonld(document: Any, graph: str | None = None) -> list[tuple]:
    """Quads of a JSON-LD document with at most a simple context (terms to IRIs, @vocab, @type coercion)."""
    doc = json.loads(document) if isinstance(document, str) else document
    scope = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(doc, sort_keys=True)).hex[:8]
    out: list[tuple] = []
    fresh = iter(range(1 << 60))

    def expand(key: str, ctx: dict) -> str | None:
        if key.startswith("@"):
            return key
        t = ctx.get(key)
        if isinstance(t, dict):
            t = t.get("@id")
        if t:
            return expand(t, {k: v for k, v in ctx.items() if k != key}) if ":" in t else t
        if ":" in key:
            p, _, rest = key.partition(":")
            base = ctx.get(p)
            return (base if isinstance(base, str) else base["@id"]) + rest if base and not rest.startswith("//") else key
        return ctx["@vocab"] + key if ctx.get("@vocab") else None

    def subject(iri: str | None) -> Any:
        if iri is None:
            return A.Blank(f"{scope}_{next(fresh)}")
        return A.Blank(f"{scope}_{iri[2:]}") if iri.startswith("_:") else A.Iri(iri)

    def literal(v: Any, dt: str | None = None, lang: str | None = None) -> A.Literal:
        if lang:
            return A.Literal(str(v), A.RDF + "langString", lang.lower())
        if isinstance(v, bool):
            return A.Literal(str(v).lower(), dt or A.XSD + "boolean")
        if isinstance(v, int):
            return A.Literal(str(v), dt or A.XSD + "integer")
        if isinstance(v, float):
            return A.Literal(repr(v), dt or A.XSD + "double")
        return A.Literal(str(v), dt or V.STRING)

    def value(v: Any, ctx: dict, coerce: str | None, g: str | None) -> Any:
        if isinstance(v, dict):
            if "@value" in v:
                return literal(v["@value"], v.get("@type") and expand(v["@type"], ctx), v.get("@language"))
            if "@list" in v:
                head: Any = A.Iri(A.RDF + "nil")
                for x in reversed(v["@list"]):
                    b = subject(None)
                    out.append(row(b, A.Iri(A.RDF + "first"), value(x, ctx, coerce, g), g))
                    out.append(row(b, A.Iri(A.RDF + "rest"), head, g))
                    head = b
                return head
            return node(v, ctx, g)
        if coerce == "@id":
            return subject(expand(v, ctx) or v)
        return literal(v, coerce)

    def node(n: dict, ctx: dict, g: str | None) -> Any:
        if isinstance(n.get("@context"), dict):
            ctx = ctx | n["@context"]
        iri = n.get("@id")
        s = subject(expand(iri, ctx) or iri if iri else None)
        if "@graph" in n:
            inner = g if iri is None else (s.value if isinstance(s, A.Iri) else "_:" + s.label)
            for x in n["@graph"] if isinstance(n["@graph"], list) else [n["@graph"]]:
                node(x, ctx, inner)
        for k, vs in n.items():
            if k in ("@id", "@context", "@graph"):
                continue
            vs = vs if isinstance(vs, list) else [vs]
            if k == "@type" or expand(k, ctx) == "@type":
                for v in vs:
                    out.append(row(s, A.Iri(A.RDF + "type"), subject(expand(v, ctx) or v), g))
                continue
            p = expand(k, ctx)
            if p is None:
                continue
            t = ctx.get(k)
            coerce = t.get("@type") if isinstance(t, dict) else None
            coerce = coerce if coerce in (None, "@id") else expand(coerce, ctx)
            for v in vs:
                if v is not None:
                    out.append(row(s, A.Iri(p), value(v, ctx, coerce, g), g))
        return s

    for d in doc if isinstance(doc, list) else [doc]:
        node(d, {}, graph)
    return out


def json_to_quads(payload: Any, subject: str, type_iri: str | None = None, context: dict[str, str] | None = None, vocab: str = "urn:json:") -> list[tuple]:
    """Quads of a plain JSON value: keys are predicates, nested objects blank nodes, arrays several values."""
    doc = json.loads(payload) if isinstance(payload, str) else payload
    context = context or {}
    out: list[tuple] = []
    fresh = iter(range(1 << 60))
    scope = uuid.uuid5(uuid.NAMESPACE_URL, subject).hex[:8]

    def walk(s: Any, d: dict) -> None:
        for k, v in d.items():
            for x in v if isinstance(v, list) else [v]:
                if x is None:
                    continue
                p = A.Iri(context.get(k, vocab + k))
                if isinstance(x, dict):
                    b = A.Blank(f"{scope}_{next(fresh)}")
                    out.append(row(s, p, b))
                    walk(b, x)
                else:
                    kind = {bool: "boolean", int: "integer", float: "double"}.get(type(x), "string")
                    out.append(row(s, p, A.Literal(str(x).lower() if kind == "boolean" else str(x), A.XSD + kind)))

    root = A.Iri(subject)
    if type_iri:
        out.append(row(root, A.Iri(A.RDF + "type"), A.Iri(type_iri)))
    walk(root, doc)
    return out


# -- files
_PARSERS = {"nt": parse_lines, "nq": parse_lines, "ttl": parse_turtle, "trig": parse_turtle, "rdf": parse_rdfxml, "xml": parse_rdfxml, "jsonld": parse_jsonld}
_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?|<<.*>>)'
_LINE = rf"^\s*{_TERM}\s*<([^>]*)>\s*{_TERM}\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"


def json_rows(rows: DataFrame, subject: Column, payload: Column, vocab: str = "urn:json:") -> DataFrame:
    """Quads of a JSON object in each row, whose subject is an IRI; rows that hold no object give nothing."""
    term = pa.struct([("kind", pa.int32()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])
    schema = pa.schema([("s", term), ("p", pa.string()), ("o", term), ("g", pa.string())])
    keys = ("kind", "lex", "dt", "lang")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = json.loads(text) if s is not None and text is not None else None
                except ValueError:
                    found = None
                if isinstance(found, dict):
                    out += [{"s": dict(zip(keys, q[0])), "p": q[1], "o": dict(zip(keys, q[2])), "g": q[3]} for q in json_to_quads(found, s, vocab=vocab)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select(subject.alias("s"), payload.alias("j")).mapInArrow(parse, QUAD_SQL)


def _term_of(c: Column) -> Column:
    """A term from its N-Triples text, by Spark's own functions."""
    body = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r'\\"', '"')):
        body = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)" + a, "$1" + b)
    body = F.replace(body, F.lit("\\\\"), F.lit("\\"))
    lang = F.lower(F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))
    dt = F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)
    return (
        F.when(c.startswith("<<"), V.struct(5, c))
        .when(c.startswith("<"), V.struct(0, F.regexp_extract(c, "^<(.*)>$", 1)))
        .when(c.startswith("_:"), V.struct(1, F.substring(c, F.lit(3), F.length(c))))
        .otherwise(V.struct(2, body, F.when(lang != "", V.LANG_STRING).when(dt != "", dt).otherwise(V.STRING), lang))
    )


def read_lines(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """N-Triples or N-Quads files as quads, by Spark's own functions. Lines that don't parse are left out.

    Lines with \\u escapes go through the parser instead.
    """
    lines = spark.read.text(path)
    plain = lines.where(~F.col("value").contains("\\u") & ~F.col("value").contains("\\U"))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    g = part(4)
    quads = plain.where(F.col("value").rlike(_LINE)).select(_term_of(part(1)).alias("s"), part(2).alias("p"), _term_of(part(3)).alias("o"), F.when(g.startswith("<"), F.regexp_extract(g, "^<(.*)>$", 1)).when(g != "", g).otherwise(F.lit(graph)).alias("g"))
    odd = lines.where(F.col("value").contains("\\u") | F.col("value").contains("\\U"))

    def parse(batches):
        import pandas as pd

        for b in batches:
            rows = parse_lines("\n".join(b["value"]), graph)
            yield pd.DataFrame([({"kind": s[0], "lex": s[1], "dt": s[2], "lang": s[3]}, p, {"kind": o[0], "lex": o[1], "dt": o[2], "lang": o[3]}, q) for s, p, o, q in rows], columns=["s", "p", "o", "g"])

    return quads.unionByName(odd.mapInPandas(parse, QUAD_SQL))


def read_file(spark: SparkSession, path: str, graph: str | None = None, fmt: str | None = None) -> DataFrame:
    """Files of any format as quads. fmt: nt, nq, ttl, trig, rdf or jsonld; from the path's ending if None."""
    fmt = fmt or re.sub(r"^.*\.(\w+)/?$", r"\1", path).lower()
    if fmt in ("nt", "nq"):
        return read_lines(spark, path, graph)
    if fmt not in _PARSERS:
        raise RdfError(f"unknown format {fmt!r}")

    def parse(batches):
        import pandas as pd

        for b in batches:
            rows = [q for text in b["value"] for q in _PARSERS[fmt](text, graph)]
            yield pd.DataFrame([({"kind": s[0], "lex": s[1], "dt": s[2], "lang": s[3]}, p, {"kind": o[0], "lex": o[1], "dt": o[2], "lang": o[3]}, q) for s, p, o, q in rows], columns=["s", "p", "o", "g"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, QUAD_SQL)


# -- sinks
def ntriples_lines(quads: DataFrame, with_graph: bool = False) -> DataFrame:
    g = F.when(F.col("g").startswith("_:"), F.col("g")).when(F.col("g").isNotNull(), F.concat(F.lit("<"), "g", F.lit(">"))) if with_graph else F.lit(None).cast("string")
    return quads.select(F.concat(F.concat_ws(" ", V.shown(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), V.shown(F.col("o")), g), F.lit(" .")).alias("value"))


def turtle_lines(quads: DataFrame) -> DataFrame:
    """One Turtle block for each subject, predicates and objects in order."""
    po = quads.groupBy("s", "p").agg(F.array_sort(F.collect_set(V.shown(F.col("o")))).alias("os"))
    verb = F.when(F.col("p") == A.RDF + "type", "a").otherwise(F.concat(F.lit("<"), "p", F.lit(">")))
    line = F.struct("p", F.concat(verb, F.lit(" "), F.array_join("os", ", ")).alias("t"))
    blocks = po.groupBy("s").agg(F.array_sort(F.collect_list(line)).alias("ps"))
    return blocks.select(F.concat(V.shown(F.col("s")), F.lit(" "), F.array_join(F.transform("ps", lambda x: x["t"]), " ;\n    "), F.lit(" .")).alias("value"))


def jsonld_nodes(quads: DataFrame) -> DataFrame:
    """One expanded JSON-LD node object for each subject."""
    o = F.col("o")
    ident = lambda t: F.when(t["kind"] == 1, F.concat(F.lit("_:"), t["lex"])).otherwise(t["lex"])
    value = F.when(o["kind"].isin(0, 1), F.to_json(F.struct(ident(o).alias("@id")))).when(o["lang"] != "", F.to_json(F.struct(o["lex"].alias("@value"), o["lang"].alias("@language")))).when(o["dt"] == V.STRING, F.to_json(F.struct(o["lex"].alias("@value")))).otherwise(F.to_json(F.struct(o["lex"].alias("@value"), o["dt"].alias("@type"))))
    is_type = F.col("p") == A.RDF + "type"
    item = F.when(is_type, F.to_json(F.struct(ident(o).alias("x"))).substr(F.lit(6), F.lit(1 << 20))).otherwise(value)
    item = F.when(is_type, F.regexp_replace(item, r"\}$", "")).otherwise(item)
    key = F.when(is_type, "@type").otherwise(F.col("p"))
    po = quads.groupBy("s", key.alias("k")).agg(F.array_sort(F.collect_set(item)).alias("vs"))
    pair = F.concat(F.lit('"'), F.replace(F.col("k"), F.lit('"'), F.lit('\\"')), F.lit('":['), F.array_join("vs", ","), F.lit("]"))
    return po.groupBy("s").agg(F.array_sort(F.collect_list(pair)).alias("ps")).select(F.concat(F.lit('{"@id":"'), ident(F.col("s")), F.lit('",'), F.array_join("ps", ","), F.lit("}")).alias("value"))
