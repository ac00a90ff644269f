"""Name -> query and name -> DuckDB statement, merged from the query families."""

from __future__ import annotations

from . import acceptance, articles, context, datasets, dense, details, evaluation, hops, protocol, reports, retrieval, sources, trajectory

FAMILIES = (retrieval, dense, trajectory, evaluation, datasets, details, sources, protocol, hops, context, articles, reports, acceptance)
QUERIES: dict = {}
ORACLES: dict = {}
for _family in FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
