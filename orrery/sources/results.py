"""Results of SELECT queries as text: CSV, TSV and JSON lines, and a cursor that reads them page by page."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _plain(c: Column) -> Column:
    """The value alone, as CSV has it: IRIs without brackets, literals without quotes, datatype or language."""
    text = c.cast("string")
    quoted = F.regexp_extract(text, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    return F.when(text.rlike(r"(?s)^<.*>$"), F.regexp_extract(text, r"(?s)^<(.*)>$", 1)).when(text.rlike(r'(?s)^".*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$'), quoted).otherwise(text)


def csv_lines(result: DataFrame) -> DataFrame:
    """A line (value) for each row; fields with a quote, comma or line end are quoted, unbound ones empty."""
    cell = lambda c: F.when(_plain(c).rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(_plain(c), '"', '""'), F.lit('"'))).otherwise(F.coalesce(_plain(c), F.lit("")))
    return result.select(F.concat_ws(",", *[cell(result[c]) for c in result.columns]).alias("value"))


def tsv_lines(result: DataFrame) -> DataFrame:
    """A line (value) for each row, terms as they are; tabs and line ends inside are escaped."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), "\t", r"\\t"), "\n", r"\\n"), "\r", r"\\r"), F.lit(""))
    return result.select(F.concat_ws("\t", *[cell(result[c]) for c in result.columns]).alias("value"))


def json_lines(result: DataFrame) -> DataFrame:
    """A JSON object (value) for each row, without unbound variables."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("value"))


def cursor(result: DataFrame, page: int = 1000) -> Iterator[list[Row]]:
    """The rows in pages. One partition at a time is held by the driver, never the whole result."""
    rows: list[Row] = []
    for r in result.toLocalIterator():
        rows.append(r)
        if len(rows) == page:
            yield rows
            rows = []
    if rows:
        yield rows
