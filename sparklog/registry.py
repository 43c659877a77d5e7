"""All queries on the log and their SQL."""

from __future__ import annotations

from sparklog.plans import anomalies, chains, detection, filtering, indicators, joining, moving, processes, profiling, reporting, script_events, sessions  # noqa: F401
from sparklog.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
