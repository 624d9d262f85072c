"""The queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from clipquery.plans import answering, exploring, judging, search, serving

MODULES = (search, answering, judging, exploring, serving)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
