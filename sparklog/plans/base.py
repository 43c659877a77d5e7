"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparklog.sources.security_log import LOG_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False, log: bool = True):
    """Register a query under its function's name.  ``sql`` may use ``security_log``, and begin with further CTEs after a comma."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{LOG_SQL}\n{sql.strip()}" if log else sql.strip()
        return f

    return register
