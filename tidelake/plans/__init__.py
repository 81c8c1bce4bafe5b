"""Registered queries: every operator run over the given tables, with its SQL twin."""

from __future__ import annotations

from tidelake.plans import (  # noqa: F401  (importing registers the queries)
    entities,
    ingest,
    queries,
    relations,
    results,
    runs,
    scans,
    sql,
    streams,
)
from tidelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
