"""R2RML: tables as quads, by a mapping in Turtle. Each triples map becomes one projection for each predicate and object."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans import algebra as A
from .rdf import RdfError, parse_turtle

RR = "http://www.w3.org/ns/r2rml#"
#: The datatype that a column's own type gives a literal; others are plain.
_NATURAL = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "double": "double", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


class Mapping:
    """A parsed mapping. ``quads`` applies it: tables gives a DataFrame for a table's name, sql one for a query."""

    def __init__(self, text: str):
        self._of: dict[tuple, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o, _ in parse_turtle(text):
            self._of[s[:2]][p].append(o)
        self.maps = [s for s, ps in self._of.items() if RR + "logicalTable" in ps]
        if not self.maps:
            raise RdfError("no triples map with a logical table")

    def _all(self, node: tuple, *names: str) -> list[tuple]:
        return [o for n in names for o in self._of[node[:2]].get(RR + n, [])]

    def _one(self, node: tuple, name: str) -> str | None:
        found = self._all(node, name)
        return found[0][1] if found else None

    def _table(self, m: tuple, tables: Callable[[str], DataFrame], sql: Callable[[str], DataFrame] | None) -> DataFrame:
        source = self._all(m, "logicalTable")[0]
        name, text = self._one(source, "tableName"), self._one(source, "sqlQuery")
        if name is None and (text is None or sql is None):
            raise RdfError("a logical table needs a name, or a query and a way to run it")
        return tables(name.strip('"')) if name is not None else sql(text)

    def _shorthand(self, m: tuple, full: str, constant: str) -> list[tuple]:
        """Term maps and constants, the latter as (None, term)."""
        return [(o, None) for o in self._all(m, full)] + [(None, o) for o in self._all(m, constant)]

    def _term(self, term_map: tuple | None, constant: tuple | None, df: DataFrame, prefix: str = "", subject: bool = False) -> Column:
        """A term for each row, null where a column of it is."""
        if constant is None and self._all(term_map, "constant"):
            constant = self._all(term_map, "constant")[0]
        if constant is not None:
            return V.struct(constant[0], F.lit(constant[1]), constant[2], constant[3])
        column, template = self._one(term_map, "column"), self._one(term_map, "template")
        kind = self._one(term_map, "termType")
        dt, lang = self._one(term_map, "datatype"), self._one(term_map, "language")
        if column is not None:
            c = column.strip('"')
            value, natural = df[prefix + c].cast("string"), _NATURAL.get(dict(df.dtypes)[prefix + c])
            literal = kind == RR + "Literal" or kind is None and not subject
        elif template is not None:
            pieces = re.split(r"\{([^}]*)\}", template)
            literal, natural = kind == RR + "Literal", None
            cell = lambda n: df[prefix + n.strip('"')].cast("string")
            value = F.concat(*[F.lit(x) if i % 2 == 0 else cell(x) if literal else F.replace(F.url_encode(cell(x)), F.lit("+"), F.lit("%20")) for i, x in enumerate(pieces)])
        else:
            raise RdfError("a term map needs a constant, a column or a template")
        if not literal:
            return F.when(value.isNotNull(), V.struct(1 if kind == RR + "BlankNode" else 0, value))
        return F.when(value.isNotNull(), V.struct(2, value, dt or (A.RDF + "langString" if lang else A.XSD + natural if natural else V.STRING), (lang or "").lower()))

    def quads(self, tables: Callable[[str], DataFrame], sql: Callable[[str], DataFrame] | None = None) -> DataFrame:
        """All quads (s, p, o, g) of the mapping. Rows with a null in a term give none with that term."""
        parts: list[DataFrame] = []

        def put(df: DataFrame, s: Column, p: Column, o: Column, graphs: list[Column]) -> None:
            for g in graphs or [F.lit(None).cast("string")]:
                parts.append(df.select(s.alias("s"), p.alias("p"), o.alias("o"), g.alias("g")).where("s is not null and p is not null and o is not null"))

        for m in self.maps:
            df = self._table(m, tables, sql)
            told = self._shorthand(m, "subjectMap", "subject")
            if len(told) != 1:
                raise RdfError("a triples map needs one subject")
            s = self._term(*told[0], df, subject=True)
            graph_of = lambda node, d: [self._term(t, c, d, subject=True)["lex"] for t, c in self._shorthand(node, "graphMap", "graph")]
            graphs = graph_of(told[0][0], df) if told[0][0] is not None else []
            for cls in self._all(told[0][0], "class") if told[0][0] is not None else []:
                put(df, s, F.lit(A.RDF + "type"), V.struct(0, F.lit(cls[1])), graphs)
            for pom in self._all(m, "predicateObjectMap"):
                more = graphs + graph_of(pom, df)
                predicates = [self._term(t, c, df, subject=True)["lex"] for t, c in self._shorthand(pom, "predicateMap", "predicate")]
                for t, c in self._shorthand(pom, "objectMap", "object"):
                    parent = self._all(t, "parentTriplesMap") if t is not None else []
                    if not parent:
                        for p in predicates:
                            put(df, s, p, self._term(t, c, df), more)
                        continue
                    other = self._table(parent[0], tables, sql)
                    both = other.select(*[other[x].alias("__parent_" + x) for x in other.columns])
                    on = [df[self._one(j, "child").strip('"')] == both["__parent_" + self._one(j, "parent").strip('"')] for j in self._all(t, "joinCondition")]
                    if not on:  # the same rows
                        o = self._term(*self._shorthand(parent[0], "subjectMap", "subject")[0], df, subject=True)
                        for p in predicates:
                            put(df, s, p, o, more)
                        continue
                    joined = df.join(both, on)
                    o = self._term(*self._shorthand(parent[0], "subjectMap", "subject")[0], joined, "__parent_", subject=True)
                    for p in predicates:
                        put(joined, s, p, o, more)
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
