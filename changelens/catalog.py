"""Queries of the change-intelligence operators, with their DuckDB SQL."""

from __future__ import annotations

from .plans import exports, feed, served, sites, state, surface, text
from .plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (text, feed, state, surface, sites, exports, served):
    QUERIES |= _part.CATALOG.queries
    ORACLES |= _part.CATALOG.oracles
