"""Typed values: what a variable or expression is, statically, and how it becomes another type.

A value has a type and a Spark column. Types are native where the data says so (numbers, strings, timestamps stay Spark
columns), ``ref`` for the IRIs of table rows (a prefix and a key column, so that joins compare keys), and ``term`` for
anything: a struct (kind, lex, dt, lang) with kind 0 IRI, 1 blank node, 2 literal, 5 quoted triple. Null is unbound.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import algebra as A

XSD, RDF = A.XSD, A.RDF
STRING, LANG_STRING = XSD + "string", RDF + "langString"
NATIVE = {"int": XSD + "integer", "dec": XSD + "decimal", "dbl": XSD + "double", "bool": XSD + "boolean", "dt": XSD + "dateTime", "date": XSD + "date", "str": STRING}
INTEGERS = [XSD + t for t in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
NUMBERS = [*INTEGERS, XSD + "decimal", XSD + "double", XSD + "float"]
TERM_SQL = "struct<kind:int,lex:string,dt:string,lang:string>"
NUMERIC = ("int", "dec", "dbl")


@dataclass(frozen=True)
class Type:
    kind: str  # iri, str, int, dec, dbl, bool, dt, date, ref, term
    prefix: str = ""


@dataclass
class Val:
    type: Type
    col: Column

    @property
    def kind(self) -> str:
        return self.type.kind


IRI, STR, INT, DEC, DBL, BOOL, DT, DATE, TERM = (Type(k) for k in ("iri", "str", "int", "dec", "dbl", "bool", "dt", "date", "term"))


def struct(kind: int | Column, lex: Column, dt: str | Column = "", lang: str | Column = "") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(kind).cast("int").alias("kind"), lex.alias("lex"), as_col(dt).alias("dt"), as_col(lang).alias("lang"))


def iri_text(v: Val) -> Column:
    return F.concat(F.lit(v.type.prefix), v.col.cast("string")) if v.kind == "ref" else v.col


def lexical(v: Val) -> Column:
    """STR() of a value."""
    if v.kind == "term":
        return v.col["lex"]
    if v.kind in ("iri", "ref"):
        return iri_text(v)
    if v.kind == "dt":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return v.col.cast("string")


def to_term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    lex = lexical(v)
    made = struct(0, lex) if v.kind in ("iri", "ref") else struct(2, lex, NATIVE[v.kind])
    return F.when(v.col.isNotNull(), made)


def constant(t: Any) -> Val:
    """The value of a term of the query; native where it can be."""
    if isinstance(t, A.Iri):
        return Val(IRI, F.lit(t.value))
    if isinstance(t, A.Blank):
        return Val(TERM, struct(1, F.lit(t.label)))
    if isinstance(t, A.Quoted):
        return Val(TERM, struct(5, F.lit(ntriples(t))))
    if t.lang:
        return Val(TERM, struct(2, F.lit(t.lex), LANG_STRING, t.lang))
    try:
        if t.dt == STRING:
            return Val(STR, F.lit(t.lex))
        if t.dt in INTEGERS and abs(int(t.lex)) < 2**63 and t.dt == XSD + "integer":
            return Val(INT, F.lit(int(t.lex)).cast("bigint"))
        if t.dt == XSD + "decimal":
            return Val(DEC, F.lit(t.lex).cast("decimal(38,18)"))
        if t.dt == XSD + "double":
            return Val(DBL, F.lit(float(t.lex)))
        if t.dt == XSD + "boolean" and t.lex in ("true", "false", "1", "0"):
            return Val(BOOL, F.lit(t.lex in ("true", "1")))
        if t.dt == XSD + "date":
            return Val(DATE, F.lit(t.lex).cast("date"))
    except ValueError:
        pass
    return Val(TERM, struct(2, F.lit(t.lex), t.dt))


def ntriples(t: Any) -> str:
    """A term of the algebra in N-Triples syntax."""
    if isinstance(t, A.Iri):
        return f"<{t.value}>"
    if isinstance(t, A.Blank):
        return f"_:{t.label}"
    if isinstance(t, A.Quoted):
        return f"<< {ntriples(t.s)} {ntriples(t.p)} {ntriples(t.o)} >>"
    text = t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{text}"' + (f"@{t.lang}" if t.lang else "" if t.dt == STRING else f"^^<{t.dt}>")


def shown(term: Column) -> Column:
    """A term column in N-Triples syntax."""
    lex = term["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    tail = F.when(term["lang"] != "", F.concat(F.lit("@"), term["lang"])).when(term["dt"].isin(STRING, ""), F.lit("")).otherwise(F.concat(F.lit("^^<"), term["dt"], F.lit(">")))
    return (
        F.when(term["kind"] == 0, F.concat(F.lit("<"), term["lex"], F.lit(">")))
        .when(term["kind"] == 1, F.concat(F.lit("_:"), term["lex"]))
        .when(term["kind"] == 5, term["lex"])
        .when(term.isNotNull(), F.concat(F.lit('"'), lex, F.lit('"'), tail))
    )


def unify(a: Type, b: Type) -> Type:
    """The type that values of both types can be given."""
    if a == b:
        return a
    kinds = {a.kind, b.kind}
    if kinds <= {"iri", "ref"}:
        return IRI
    if kinds <= set(NUMERIC):
        return DBL if "dbl" in kinds else DEC
    return TERM


def convert(v: Val, to: Type) -> Column:
    if v.type == to:
        return v.col
    if to.kind == "term":
        return to_term(v)
    if to.kind == "iri":
        return iri_text(v)
    return v.col.cast({"dbl": "double", "dec": "decimal(38,18)", "int": "bigint", "str": "string"}[to.kind])


def numeric(v: Val) -> Column:
    """The number that a value is, as double; null if none."""
    if v.kind in NUMERIC:
        return v.col.cast("double")
    if v.kind == "term":
        return F.when((v.col["kind"] == 2) & v.col["dt"].isin(NUMBERS), v.col["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def instant(v: Val) -> Column:
    if v.kind in ("dt", "date"):
        return v.col.cast("timestamp_ntz")
    if v.kind == "term":
        return F.when((v.col["kind"] == 2) & v.col["dt"].isin(XSD + "dateTime", XSD + "date"), v.col["lex"].try_cast("timestamp").cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def text(v: Val) -> Column:
    """The characters of a string literal (plain or tagged); null for anything else."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((v.col["kind"] == 2) & v.col["dt"].isin(STRING, LANG_STRING), v.col["lex"])
    return F.lit(None).cast("string")


def truth(v: Val) -> Column:
    """Effective boolean value; null is an error."""
    if v.kind == "bool":
        return v.col
    if v.kind in NUMERIC:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "str":
        return v.col != ""
    if v.kind == "term":
        n = numeric(v)
        c = v.col
        return F.when((c["kind"] == 2) & (c["dt"] == XSD + "boolean"), c["lex"].isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when((c["kind"] == 2) & c["dt"].isin(NUMBERS), F.lit(False)).when(text(v).isNotNull(), text(v) != "")
    return F.lit(None).cast("boolean")


def order_keys(v: Val) -> list[Column]:
    """Columns that sort values in SPARQL's order: unbound, blank nodes, IRIs, literals (numbers by value, then others)."""
    if v.kind == "ref":
        return [v.col]
    if v.kind != "term":
        return [v.col]
    c = v.col
    rank = F.when(c.isNull(), 0).when(c["kind"] == 1, 1).when(c["kind"] == 0, 2).when(c["kind"] == 5, 5).when(c["dt"].isin(NUMBERS), 3).otherwise(4)
    return [rank, numeric(v), c["lex"], c["dt"], c["lang"]]


def same_term(a: Val, b: Val) -> Column:
    if a.type == b.type:
        return a.col == b.col
    if a.kind in ("iri", "ref") and b.kind in ("iri", "ref"):
        return iri_text(a) == iri_text(b)
    return to_term(a) == to_term(b)


def equal(a: Val, b: Val) -> Column:
    """SPARQL ``=``: by value for numbers, times, strings and booleans; terms otherwise."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.col == b.col
    if a.kind != "term" and b.kind != "term":
        if a.type == b.type or {a.kind, b.kind} <= {"iri", "ref"}:
            return same_term(a, b)
        if {a.kind, b.kind} <= {"dt", "date"}:
            return instant(a) == instant(b)
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    x, y = numeric(a), numeric(b)
    s, t = instant(a), instant(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).when(s.isNotNull() & t.isNotNull(), s == t).otherwise(to_term(a) == to_term(b))


def less(a: Val, b: Val, op: str) -> Column:
    """``<``, ``<=``, ``>`` or ``>=`` of numbers, times, strings and booleans; null for anything else."""
    cmp = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.kind in NUMERIC and b.kind in NUMERIC or a.kind == b.kind and a.kind in ("str", "bool"):
        return cmp(a.col, b.col)
    if {a.kind, b.kind} <= {"dt", "date"}:
        return cmp(instant(a), instant(b))
    if "term" not in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    x, y, s, t = numeric(a), numeric(b), instant(a), instant(b)
    return F.when(x.isNotNull() & y.isNotNull(), cmp(x, y)).when(s.isNotNull() & t.isNotNull(), cmp(s, t)).otherwise(cmp(text(a), text(b)))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Promoted arithmetic; null for what isn't a number and for division by zero."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        to = unify(a.type, b.type) if a.type != b.type else a.type
        if op == "/":
            to = DBL if to == DBL else DEC
        x, y = convert(a, to), convert(b, to)
    elif "term" in (a.kind, b.kind):
        to, x, y = DBL, numeric(a), numeric(b)
    else:
        return Val(DBL, F.lit(None).cast("double"))
    fn = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    out = fn(x, y)
    return Val(to, out.cast("decimal(38,18)") if to == DEC else out)
