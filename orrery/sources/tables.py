"""Relational tables seen as a graph, without making triples: row to subject, column to predicate.

The subject of a row is ``urn:<table>:<key>``, its class ``urn:class:<table>``, a column's predicate ``urn:col:<column>``
(``urn:col:<table>.<column>`` where several tables have it). Foreign keys are edges to other rows. A star of patterns over one
subject becomes one scan of its table with just the columns that are named. Rows of a table without a key are blank nodes
told apart by all their values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import BOOL, DATE, DBL, DEC, DT, INT, IRI, STR, TERM, Type, Val, constant, equal, iri_text, to_term
from ..plans import algebra as A

COL, CLASS = "urn:col:", "urn:class:"
_TYPES = {"bigint": INT, "int": INT, "smallint": INT, "tinyint": INT, "double": DBL, "float": DBL, "string": STR, "boolean": BOOL, "timestamp_ntz": DT, "timestamp": DT, "date": DATE}


@dataclass
class Table:
    name: str
    df: DataFrame
    key: str | None = None
    refs: dict[str, str] = field(default_factory=dict)  # column -> table

    @property
    def prefix(self) -> str:
        return f"urn:{self.name}:"

    def subject(self) -> Val:
        if self.key:
            return Val(Type("ref", self.prefix), self.df[self.key].cast("bigint") if dict(self.df.dtypes)[self.key] in ("int", "bigint") else self.df[self.key])
        return Val(Type("ref", f"_:{self.name}:"), F.struct(*[self.df[c] for c in self.df.columns]))

    def value(self, column: str) -> Val:
        kind = dict(self.df.dtypes)[column]
        c = self.df[column]
        if column in self.refs:
            return Val(Type("ref", f"urn:{self.refs[column]}:"), c.cast("bigint"))
        if kind.startswith("decimal"):
            return Val(DEC, c.cast("decimal(38,18)"))
        t = _TYPES[kind]
        return Val(t, c.cast("bigint") if t == INT else c.cast("double") if t == DBL else c.cast("timestamp_ntz") if t == DT else c)


class TableGraph:
    """A graph over tables. It has a default graph only."""

    def __init__(self, tables: list[Table]):
        self.tables = {t.name: t for t in tables}
        self.spark: SparkSession = tables[0].df.sparkSession
        self.row_subjects = True  # a subject is one row
        self.columns: dict[str, tuple[Table, str]] = {}
        seen: dict[str, list[Table]] = {}
        for t in tables:
            for c, kind in t.df.dtypes:
                if kind in _TYPES or kind.startswith("decimal"):
                    seen.setdefault(c, []).append(t)
                    self.columns[f"{COL}{t.name}.{c}"] = (t, c)
        for c, owners in seen.items():
            if len(owners) == 1:
                self.columns[COL + c] = (owners[0], c)

    def star(self, subject, pairs: list, ctx) -> list[tuple[DataFrame, dict[str, Type]]]:
        """Solutions of patterns (subject, p, o), as alternatives whose union they are."""
        if ctx.graph is not None:
            return []
        by_table: dict[str, list] = {}
        loose, typed = [], []
        for p, o in pairs:
            if isinstance(p, A.Iri) and p.value in self.columns:
                by_table.setdefault(self.columns[p.value][0].name, []).append((p, o))
            elif isinstance(p, A.Iri) and p.value == A.RDF + "type":
                typed.append((p, o))
            elif isinstance(p, A.Iri):
                return []
            else:
                loose.append((p, o))
        for p, o in typed:
            if isinstance(o, A.Iri) and o.value.removeprefix(CLASS) in self.tables:
                by_table.setdefault(o.value.removeprefix(CLASS), [])
            elif isinstance(o, A.Iri):
                return []
        if len(by_table) > 1:
            return []  # a row belongs to one table
        if isinstance(subject, A.Iri) and not by_table:
            by_table = {t.name: [] for t in self.tables.values() if subject.value.startswith(t.prefix)}
            if not by_table:
                return []
        names = list(by_table) or list(self.tables)
        out = []
        for name in names:
            one = self._scan(self.tables[name], subject, by_table.get(name, []), typed, loose)
            out += one
        return out

    def _scan(self, t: Table, subject, known: list, typed: list, loose: list) -> list[tuple[DataFrame, dict[str, Type]]]:
        choices: list[list[tuple]] = [[]]
        for p, o in loose:  # a variable predicate: any column, or the class
            options = [(p, o, c) for c, kind in t.df.dtypes if kind in _TYPES or kind.startswith("decimal")] + [(p, o, None)]
            choices = [c + [x] for c in choices for x in options]
        out = []
        for extra in choices:
            vals: dict[str, Val] = {}
            conds: list[Column] = []

            def bind(node, val: Val, vals=vals, conds=conds) -> bool:
                if isinstance(node, (A.Var, A.Blank)):
                    name = node.name if isinstance(node, A.Var) else "__n_" + node.label
                    if name in vals:
                        conds.append(equal(vals[name], val))
                    else:
                        vals[name] = val
                    return True
                want = constant(node)
                if val.kind == "ref":
                    if not isinstance(node, A.Iri) or not node.value.startswith(val.type.prefix):
                        return False
                    conds.append(val.col == F.lit(node.value[len(val.type.prefix) :]).try_cast("bigint"))
                else:
                    conds.append(equal(val, want))
                return True

            ok = bind(subject, t.subject())
            for p, o in known:
                c = self.columns[p.value][1]
                conds.append(t.df[c].isNotNull())
                ok = ok and bind(o, t.value(c))
            for _, o in typed:
                ok = ok and bind(o, Val(IRI, F.lit(CLASS + t.name)))
            for p, o, c in extra:
                iri = A.RDF + "type" if c is None else (COL + c if self.columns.get(COL + c, (None,))[0] is t else f"{COL}{t.name}.{c}")
                ok = ok and bind(p, Val(IRI, F.lit(iri)))
                v = Val(IRI, F.lit(CLASS + t.name)) if c is None else t.value(c)
                if c is not None:
                    conds.append(t.df[c].isNotNull())
                ok = ok and bind(o, Val(TERM, to_term(v)))
            if not ok:
                continue
            df = t.df
            for c in conds:
                df = df.where(c)
            out.append((df.select(*[v.col.alias(n) for n, v in vals.items()]), {n: v.type for n, v in vals.items()}))
        return out

    def nodes(self, ctx) -> tuple[DataFrame, Type]:
        """All subjects and objects as terms."""
        parts = []
        for t in self.tables.values():
            vals = [t.subject()] + [t.value(c) for c, k in t.df.dtypes if k in _TYPES]
            parts.append(t.df.select(F.explode(F.array(*[to_term(v) for v in vals])).alias("n")).where("n is not null"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct(), TERM

    def graphs(self) -> list[str]:
        return []


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": None, "conversations": None}
REFS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "labels": {"labels.doc_id": "documents"}}


def star_schema(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> TableGraph:
    """The graph over the given tables of a folder (all of them if None)."""
    return TableGraph([Table(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS.get(n), REFS.get(n, {})) for n in (names or KEYS)])


__all__ = ["Table", "TableGraph", "star_schema", "iri_text"]
