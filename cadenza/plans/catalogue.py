"""All registered queries over the driver tables, with their SQL counterparts."""

from __future__ import annotations

from cadenza.plans import detector_queries, document_queries, list_queries, run_queries, series_queries, text_queries

_MODULES = (series_queries, list_queries, text_queries, document_queries, detector_queries, run_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.Q.queries.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.Q.oracles.items()}
