"""SPARQL 1.1 query and update parser (with quoted triples, LATERAL and the ARQ aggregates MEDIAN and MODE)."""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import urljoin

from . import algebra as A


class SparqlError(ValueError):
    """The text isn't a query or update that is understood."""


_TOKEN = re.compile(
    r"""(?P<ws>(?:\s|\#[^\n]*)+)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<qopen><<)|(?P<qclose>>>)
  |(?P<str>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<dt>\^\^)
  |(?P<num>(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<var>[?$][A-Za-z0-9_·À-￿]+)
  |(?P<bnode>_:[A-Za-z0-9_À-￿](?:[A-Za-z0-9_.\-·À-￿]*[A-Za-z0-9_\-·À-￿])?)
  |(?P<pname>(?:[A-Za-zÀ-￿](?:[A-Za-z0-9_.\-·À-￿]*[A-Za-z0-9_\-·À-￿])?)?:(?:(?:[A-Za-z0-9_:À-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[A-Za-z0-9_.\-:·À-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[A-Za-z0-9_\-:·À-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<word>[A-Za-z][A-Za-z0-9_]*)
  |(?P<op>&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?&])
""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
_AGGREGATES = {"count", "sum", "min", "max", "avg", "sample", "group_concat", "median", "mode"}
_NUMERIC = {"int": A.XSD + "integer", "dec": A.XSD + "decimal", "dbl": A.XSD + "double"}


def unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), s) if "\\" in s else s


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.prefixes, self.base = dict(prefixes or {}), base
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise SparqlError(f"unexpected text at {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.toks.append((m.lastgroup or "", m.group()))
            at = m.end()
        self.toks.append(("end", ""))
        self.i = 0
        self.fresh = 0
        self.aggs: list[tuple[str, A.Agg]] | None = None

    # -- tokens
    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    @property
    def text(self) -> str:
        return self.toks[self.i][1]

    def word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.lower() in words

    def op(self, *ops: str) -> bool:
        return self.kind in ("op", "qopen", "qclose", "dt") and self.text in ops

    def next(self) -> str:
        self.i += 1
        return self.toks[self.i - 1][1]

    def take(self, *ops: str) -> bool:
        if self.op(*ops):
            self.i += 1
            return True
        return False

    def taken(self, *words: str) -> bool:
        if self.word(*words):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise SparqlError(f"expected {op!r}, found {self.text!r}")

    def needed(self, word: str) -> None:
        if not self.taken(word):
            raise SparqlError(f"expected {word.upper()}, found {self.text!r}")

    def new(self, what: str = "b") -> A.Var:
        self.fresh += 1
        return A.Var(f"__{what}{self.fresh}")

    # -- entry points
    def prologue(self) -> None:
        while True:
            if self.taken("prefix"):
                name = self.next()
                self.prefixes[name[:-1]] = self.iri_text(self.next())
            elif self.taken("base"):
                self.base = self.iri_text(self.next())
            else:
                return

    def iri_text(self, t: str) -> str:
        raw = unescape(t[1:-1])
        return urljoin(self.base, raw) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", raw) else raw

    def query(self) -> A.Query:
        self.prologue()
        form = self.text.lower()
        if form == "select":
            default, named = [], []
            pattern, names = self.select((default, named))
            q = A.Query("select", pattern, default_graphs=tuple(default), named_graphs=tuple(named), variables=names)
        elif form == "ask":
            self.next()
            default, named = self.dataset()
            pattern = self.modifiers(self.where(), None, [], False)
            q = A.Query("ask", pattern, default_graphs=default, named_graphs=named)
        elif form == "construct":
            self.next()
            if self.op("{"):
                template = self.template()
                default, named = self.dataset()
                pattern = self.modifiers(self.where(), None, [], False)
            else:
                default, named = self.dataset()
                self.needed("where")
                at = self.i
                template = self.template()
                self.i = at
                pattern = self.modifiers(self.group(), None, [], False)
            q = A.Query("construct", pattern, template=template, default_graphs=default, named_graphs=named)
        elif form == "describe":
            self.next()
            what: list[Any] = []
            while self.kind in ("var", "iri", "pname"):
                what.append(A.Var(self.next()[1:]) if self.kind == "var" else self.iri())
            star = self.take("*")
            default, named = self.dataset()
            pattern = self.modifiers(self.where() if self.word("where") or self.op("{") else A.Bgp(()), None, [], False)
            q = A.Query("describe", pattern, describe=("*",) if star else tuple(what), default_graphs=default, named_graphs=named)
        else:
            raise SparqlError(f"not a query form: {self.text!r}")
        if self.kind != "end":
            raise SparqlError(f"unexpected {self.text!r} after the query")
        return q

    def dataset(self) -> tuple[tuple, tuple]:
        default, named = [], []
        while self.taken("from"):
            (named if self.taken("named") else default).append(self.iri().value)
        return tuple(default), tuple(named)

    def where(self) -> Any:
        self.taken("where")
        return self.group()

    def select(self, into: tuple[list, list] | None = None) -> tuple[Any, tuple]:
        self.needed("select")
        distinct = bool(self.taken("distinct", "reduced"))
        outer, self.aggs = self.aggs, []
        items: list[tuple[str, Any]] | None = []
        if self.take("*"):
            items = None
        else:
            while True:
                if self.kind == "var":
                    items.append((self.next()[1:], None))
                elif self.take("("):
                    e = self.expression()
                    self.needed("as")
                    items.append((self.next()[1:], e))
                    self.need(")")
                else:
                    break
        if into is not None:
            d, n = self.dataset()
            into[0].extend(d)
            into[1].extend(n)
        aggs = self.aggs
        pattern = self.where()
        out = self.modifiers(pattern, items, aggs, distinct)
        self.aggs = outer
        return out, tuple(n for n, _ in items) if items is not None else ("*",)

    def modifiers(self, pattern: Any, items: list | None, aggs: list, distinct: bool) -> Any:
        self.aggs = aggs
        keys: list[tuple[str, Any]] = []
        grouped = False
        if self.taken("group"):
            self.needed("by")
            grouped = True
            while True:
                if self.kind == "var":
                    v = self.next()[1:]
                    keys.append((v, A.Var(v)))
                elif self.take("("):
                    e = self.expression()
                    name = self.next()[1:] if self.taken("as") else self.new("g").name
                    self.need(")")
                    keys.append((name, e))
                elif (self.kind == "word" and not self.word("having", "order", "limit", "offset", "values")) or self.kind in ("iri", "pname"):
                    keys.append((self.new("g").name, self.primary()))
                else:
                    break
        having: list[Any] = []
        if self.taken("having"):
            while self.op("(") or (self.kind == "word" and not self.word("order", "limit", "offset", "values")):
                having.append(self.primary())
        order: list[tuple[Any, bool]] = []
        if self.taken("order"):
            self.needed("by")
            while True:
                if self.word("asc", "desc"):
                    asc = self.next().lower() == "asc"
                    self.need("(")
                    order.append((self.expression(), asc))
                    self.need(")")
                elif self.kind == "var":
                    order.append((A.Var(self.next()[1:]), True))
                elif self.op("(") or (self.kind == "word" and not self.word("limit", "offset", "values")) or self.kind in ("iri", "pname"):
                    order.append((self.primary(), True))
                else:
                    break
        limit, offset = None, 0
        while self.word("limit", "offset"):
            if self.next().lower() == "limit":
                limit = int(self.next())
            else:
                offset = int(self.next())
        values = self.values() if self.taken("values") else None
        if grouped or aggs:
            pattern = A.Group(pattern, tuple(keys), tuple(aggs))
        for h in having:
            pattern = A.Filter(pattern, h)
        if values is not None:
            pattern = A.Join(pattern, values)
        for name, e in items or []:
            if e is not None:
                pattern = A.Extend(pattern, name, e)
        if order:
            pattern = A.OrderBy(pattern, tuple(order))
        pattern = A.Project(pattern, tuple(n for n, _ in items) if items is not None else None)
        if distinct:
            pattern = A.Distinct(pattern)
        if limit is not None or offset:
            pattern = A.Slice(pattern, limit, offset)
        return pattern

    # -- patterns
    def group(self) -> Any:
        self.need("{")
        if self.word("select"):
            out, _ = self.select()
            self.need("}")
            return out
        out: Any = A.Bgp(())
        filters: list[Any] = []

        def join(x: Any) -> None:
            nonlocal out
            out = x if out == A.Bgp(()) else A.Join(out, x)

        while not self.take("}"):
            if self.taken("filter"):
                filters.append(self.constraint())
            elif self.taken("optional"):
                inner = self.group()
                on = None
                while isinstance(inner, A.Filter):
                    on = inner.on if on is None else A.Call("&&", (on, inner.on))
                    inner = inner.inner
                out = A.LeftJoin(out, inner, on)
            elif self.taken("minus"):
                out = A.Minus(out, self.group())
            elif self.taken("lateral"):
                out = A.Lateral(out, self.group())
            elif self.taken("graph"):
                name = A.Var(self.next()[1:]) if self.kind == "var" else self.iri()
                join(A.GraphPattern(name, self.group()))
            elif self.taken("service"):
                silent = self.taken("silent")
                name = A.Var(self.next()[1:]) if self.kind == "var" else self.iri()
                join(A.Service(name, self.group(), silent))
            elif self.taken("bind"):
                self.need("(")
                e = self.expression()
                self.needed("as")
                out = A.Extend(out, self.next()[1:], e)
                self.need(")")
            elif self.taken("values"):
                join(self.values())
            elif self.op("{"):
                parts = [self.group()]
                while self.taken("union"):
                    parts.append(self.group())
                join(parts[0] if len(parts) == 1 else A.Union(tuple(parts)))
            elif self.take("."):
                continue
            else:
                triples = self.triples()
                if isinstance(out, A.Bgp):
                    out = A.Bgp(out.triples + triples)
                elif isinstance(out, A.Join) and isinstance(out.right, A.Bgp):
                    out = A.Join(out.left, A.Bgp(out.right.triples + triples))
                else:
                    join(A.Bgp(triples))
        for f in filters:
            out = A.Filter(out, f)
        return out

    def values(self) -> A.Values:
        many = self.take("(")
        names = []
        while self.kind == "var":
            names.append(self.next()[1:])
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(None if self.taken("undef") else self.term())
                rows.append(tuple(row))
            else:
                rows.append((None if self.taken("undef") else self.term(),))
        return A.Values(tuple(names), tuple(rows))

    def template(self) -> tuple:
        self.need("{")
        out: tuple = ()
        while not self.take("}"):
            if not self.take("."):
                out += self.triples()
        return out

    def triples(self) -> tuple:
        out: list[A.Triple] = []
        subject = self.node(out)
        if not (self.op(".", "}") or self.kind == "end"):
            self.properties(subject, out)
        elif not out:  # only a node that says something by itself, [ ... ] or ( ... ), may stand alone
            raise SparqlError(f"expected a predicate, found {self.text!r}")
        self.take(".")
        return tuple(out)

    def properties(self, subject: Any, out: list) -> None:
        while True:
            if self.kind == "var":
                verb: Any = A.Var(self.next()[1:])
            else:
                verb = self.path()
            while True:
                out.append(A.Triple(subject, verb, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.op(".", "}", "]") or self.kind == "end" or self.word("filter", "optional", "bind", "union", "minus", "values", "graph", "service"):
                return

    def node(self, out: list) -> Any:
        if self.take("["):
            b = self.new()
            if not self.op("]"):
                self.properties(b, out)
            self.need("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head: Any = A.Iri(A.RDF + "nil")
            for x in reversed(items):
                b = self.new()
                out += [A.Triple(b, A.Iri(A.RDF + "first"), x), A.Triple(b, A.Iri(A.RDF + "rest"), head)]
                head = b
            return head
        return self.term()

    def term(self) -> Any:
        if self.take("<<"):
            s = self.term()
            p = A.Var(self.next()[1:]) if self.kind == "var" else self.iri_or_a()
            o = self.term()
            self.need(">>")
            return A.Quoted(s, p, o)
        if self.kind == "var":
            return A.Var(self.next()[1:])
        if self.kind == "bnode":
            return A.Blank(self.next()[2:])
        if self.kind in ("iri", "pname"):
            return self.iri()
        if self.kind == "str":
            t = self.next()
            q = 3 if t[:3] in ('"""', "'''") else 1
            lex = unescape(t[q:-q])
            if self.kind == "lang":
                return A.Literal(lex, A.RDF + "langString", self.next()[1:].lower())
            if self.take("^^"):
                return A.Literal(lex, self.iri().value)
            return A.Literal(lex)
        sign = self.next() if self.op("+", "-") else ""
        if self.kind == "num":
            t = self.next()
            k = "dbl" if "e" in t.lower() else "dec" if "." in t else "int"
            return A.Literal(sign.replace("+", "") + t, _NUMERIC[k])
        if self.word("true", "false"):
            return A.Literal(self.next().lower(), A.XSD + "boolean")
        raise SparqlError(f"expected a term, found {self.text!r}")

    def iri(self) -> A.Iri:
        if self.kind == "iri":
            return A.Iri(self.iri_text(self.next()))
        if self.kind == "pname":
            p, _, local = self.next().partition(":")
            if p not in self.prefixes:
                raise SparqlError(f"unknown prefix {p!r}")
            return A.Iri(self.prefixes[p] + re.sub(r"\\(.)", r"\1", local))
        raise SparqlError(f"expected an IRI, found {self.text!r}")

    def iri_or_a(self) -> A.Iri:
        if self.kind == "word" and self.text == "a":
            self.next()
            return A.Iri(A.RDF + "type")
        return self.iri()

    # -- paths
    def path(self) -> Any:
        parts = [self.path_seq()]
        while self.take("|"):
            parts.append(self.path_seq())
        return parts[0] if len(parts) == 1 else A.Path("alt", tuple(parts))

    def path_seq(self) -> Any:
        parts = [self.path_elt()]
        while self.take("/"):
            parts.append(self.path_elt())
        return parts[0] if len(parts) == 1 else A.Path("seq", tuple(parts))

    def path_elt(self) -> Any:
        if self.take("^"):
            return A.Path("inv", (self.path_elt(),))
        if self.take("!"):
            fwd, back = [], []
            many = self.take("(")
            while True:
                (back if self.take("^") else fwd).append(self.iri_or_a().value)
                if not (many and self.take("|")):
                    break
            if many:
                self.need(")")
            return A.Path("not", (tuple(fwd), tuple(back)))
        if self.take("("):
            p = self.path()
            self.need(")")
        else:
            p = self.iri_or_a()
        while self.op("*", "+", "?"):
            p = A.Path({"*": "star", "+": "plus", "?": "opt"}[self.next()], (p,))
        return p

    # -- expressions
    def constraint(self) -> Any:
        return self.primary()

    def expression(self) -> Any:
        e = self.conj()
        while self.take("||"):
            e = A.Call("||", (e, self.conj()))
        return e

    def conj(self) -> Any:
        e = self.relation()
        while self.take("&&"):
            e = A.Call("&&", (e, self.relation()))
        return e

    def relation(self) -> Any:
        e = self.sum()
        if self.op("=", "!=", "<", ">", "<=", ">="):
            return A.Call(self.next(), (e, self.sum()))
        if self.word("in") or (self.word("not") and self.toks[self.i + 1][1].lower() == "in"):
            name = "in" if self.next().lower() == "in" else "notin"
            if name == "notin":
                self.next()
            self.need("(")
            args = [e]
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            return A.Call(name, tuple(args))
        return e

    def sum(self) -> Any:
        e = self.product()
        while self.op("+", "-"):
            e = A.Call(self.next(), (e, self.product()))
        return e

    def product(self) -> Any:
        e = self.unary()
        while self.op("*", "/"):
            e = A.Call(self.next(), (e, self.unary()))
        return e

    def unary(self) -> Any:
        if self.take("!"):
            return A.Call("!", (self.unary(),))
        if self.op("-") and self.toks[self.i + 1][0] != "num":
            self.next()
            return A.Call("neg", (self.unary(),))
        if self.op("+") and self.toks[self.i + 1][0] != "num":
            self.next()
            return self.unary()
        return self.primary()

    def primary(self) -> Any:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.word("exists"):
            self.next()
            return A.Exists(self.sealed(), True)
        if self.word("not"):
            self.next()
            self.needed("exists")
            return A.Exists(self.sealed(), False)
        if self.kind == "word" and not self.word("true", "false"):
            name = self.next().lower()
            if name in _AGGREGATES:
                return self.aggregate(name)
            return A.Call(name, self.arguments())
        if self.kind in ("iri", "pname"):
            iri = self.iri()
            if self.op("("):
                if iri.value.startswith("urn:arq:") and iri.value[8:] in ("median", "mode"):
                    return self.aggregate(iri.value[8:])
                return A.Call(iri.value, self.arguments())
            return iri
        return self.term()

    def sealed(self) -> Any:
        outer, self.aggs = self.aggs, []
        out = self.group()
        self.aggs = outer
        return out

    def arguments(self) -> tuple:
        self.need("(")
        args = []
        self.taken("distinct")
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        return tuple(args)

    def aggregate(self, name: str) -> Any:
        self.need("(")
        distinct = bool(self.taken("distinct"))
        arg = None if self.take("*") else self.expression()
        sep = " "
        if self.take(";"):
            self.needed("separator")
            self.need("=")
            sep = self.term().lex
        self.need(")")
        if self.aggs is None:
            raise SparqlError("an aggregate outside of a grouped query")
        agg = A.Agg(name, arg, distinct, sep)
        for v, a in self.aggs:
            if a == agg:
                return A.Var(v)
        v = self.new("a")
        self.aggs.append((v.name, agg))
        return v

    # -- updates
    def updates(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.update())
            if not self.take(";") and self.kind != "end":
                raise SparqlError(f"unexpected {self.text!r}")

    def target(self) -> Any:
        if self.word("default", "named", "all"):
            return self.next().lower()
        self.taken("graph")
        return self.iri()

    def update(self) -> A.Update:
        if self.taken("insert"):
            if self.taken("data"):
                return A.Update("insert_data", insert=self.quads())
            insert = self.quads()
            return self.modify(None, (), insert)
        if self.taken("delete"):
            if self.taken("data"):
                return A.Update("delete_data", delete=self.quads())
            if self.taken("where"):
                at = self.i
                quads = self.quads()
                self.i = at
                return A.Update("modify", delete=quads, pattern=self.group())
            delete = self.quads()
            insert = self.quads() if self.taken("insert") else ()
            return self.modify(None, delete, insert)
        if self.taken("with"):
            graph = self.iri()
            delete = self.quads() if self.taken("delete") else ()
            insert = self.quads() if self.taken("insert") else ()
            return self.modify(graph, delete, insert)
        for name in ("clear", "drop", "create"):
            if self.taken(name):
                silent = bool(self.taken("silent"))
                return A.Update(name, target=self.target(), silent=silent)
        for name in ("add", "copy", "move"):
            if self.taken(name):
                silent = bool(self.taken("silent"))
                source = self.target()
                self.needed("to")
                return A.Update(name, source=source, target=self.target(), silent=silent)
        if self.taken("load"):
            silent = bool(self.taken("silent"))
            source = self.iri()
            return A.Update("load", source=source, target=(self.taken("graph") or True) and self.iri() if self.taken("into") else "default", silent=silent)
        raise SparqlError(f"not an update: {self.text!r}")

    def modify(self, graph: Any, delete: tuple, insert: tuple) -> A.Update:
        using, named = [], []
        while self.taken("using"):
            (named if self.taken("named") else using).append(self.iri().value)
        self.needed("where")
        return A.Update("modify", insert=insert, delete=delete, pattern=self.group(), graph=graph, using=tuple(using), using_named=tuple(named))

    def quads(self) -> tuple:
        self.need("{")
        out: list[tuple[Any, A.Triple]] = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.taken("graph"):
                name = A.Var(self.next()[1:]) if self.kind == "var" else self.iri()
                out += [(name, t) for t in self.template()]
            else:
                out += [(None, t) for t in self.triples()]
        return tuple(out)


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[A.Update]:
    return Parser(text, prefixes).updates()
