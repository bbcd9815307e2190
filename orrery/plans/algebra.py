"""The algebra that queries are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SH = "http://www.w3.org/ns/shacl#"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str = XSD + "string"
    lang: str | None = None


@dataclass(frozen=True)
class Quoted:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any  # Var, Iri or Path
    o: Any


@dataclass(frozen=True)
class Path:
    """op: inv, seq, alt, plus, star, opt, not; args: paths or Iris. ``not`` holds (forward, backward) tuples of Iris."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Bgp:
    triples: tuple


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any


@dataclass(frozen=True)
class LeftJoin:
    left: Any
    right: Any
    on: Any = None


@dataclass(frozen=True)
class Lateral:
    left: Any
    right: Any


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Minus:
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    inner: Any
    on: Any


@dataclass(frozen=True)
class Extend:
    inner: Any
    var: str
    expr: Any


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple


@dataclass(frozen=True)
class GraphPattern:
    name: Any
    inner: Any


@dataclass(frozen=True)
class Service:
    name: Any
    inner: Any
    silent: bool


@dataclass(frozen=True)
class Group:
    inner: Any
    keys: tuple  # (var name, expression)
    aggs: tuple  # (var name, Agg)


@dataclass(frozen=True)
class Project:
    inner: Any
    vars: tuple | None


@dataclass(frozen=True)
class Distinct:
    inner: Any


@dataclass(frozen=True)
class OrderBy:
    inner: Any
    keys: tuple  # (expression, ascending)


@dataclass(frozen=True)
class Slice:
    inner: Any
    limit: int | None
    offset: int


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any
    distinct: bool = False
    sep: str = " "


@dataclass(frozen=True)
class Call:
    """A function or operator applied to expressions. ops: || && ! = != < <= > >= + - * / neg in notin, lower-case function names, or an IRI."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: Any
    positive: bool


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    pattern: Any
    template: tuple = ()
    describe: tuple = ()
    default_graphs: tuple = ()
    named_graphs: tuple = ()
    variables: tuple = ()


@dataclass
class Update:
    op: str  # insert_data, delete_data, modify, load, clear, drop, create, add, copy, move
    insert: tuple = ()  # (graph or None, Triple)
    delete: tuple = ()
    pattern: Any = None
    graph: Any = None
    target: Any = None
    source: Any = None
    using: tuple = field(default=())
    using_named: tuple = field(default=())
    silent: bool = False
