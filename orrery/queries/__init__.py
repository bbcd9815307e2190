"""Registered queries, each with the SQL that a reference database answers alike where SQL can say it."""

from __future__ import annotations

from .base import ORACLE_SQL, QUERIES
from . import more, reasoning, sparql  # noqa: E402, F401, I001

__all__ = ["ORACLE_SQL", "QUERIES"]
