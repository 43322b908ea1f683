"""All queries of the library's own operators, by name, and their SQL."""

from __future__ import annotations

from tallyloom.plans import catalog, engagement, extraction, grounding, messages, outreach, pages, price_grids, ranking, reports, scoring, search, streaming

_MODULES = [engagement, catalog, scoring, ranking, messages, pages, search, outreach, streaming, grounding, price_grids, extraction, reports]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
