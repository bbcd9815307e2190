"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EXT, GEOF
from ..plans import algebra as A
from ..sources.quads import select
from ..sources.tables import star_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PREFIXES = {"col": "urn:col:", "class": "urn:class:", "xsd": A.XSD, "rdf": A.RDF, "fn": EXT, "geof": GEOF, "r": "urn:region:", "n": "urn:nation:"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles to a number of digits, so that the order of additions doesn't show; decimals become doubles first."""
    names = [c for c, t in df.dtypes if t == "double" or t.startswith("decimal")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names})


def sparql(name: str, text: str, sql: str | None, tables: str, digits: int = 2) -> None:
    """Registers a SPARQL query over the given tables seen as a graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(select(star_schema(spark, sf_dir, tables.split()), text, PREFIXES), digits)

    run.__name__ = name
    query(name, sql)(run)
