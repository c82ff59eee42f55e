"""All queries of the library and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from quillon.plans import dashboards, documents, inventory, layers, pos, refresh, retrieval, signals

MODULES = [layers, dashboards, pos, documents, retrieval, signals, refresh, inventory]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
