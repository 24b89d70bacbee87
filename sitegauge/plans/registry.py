"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from sitegauge.plans import queries_events, queries_pages, queries_state, queries_text

_MODULES = (queries_pages, queries_state, queries_text, queries_events)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
