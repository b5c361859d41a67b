"""All queries of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from . import analytics, feeds, intake, ledgers, models, more, relational, reports  # noqa: F401
from .core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["q01_closing_line_ledger"](spark, sf_dir)
