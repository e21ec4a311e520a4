"""All queries of the library itself, and their SQL."""

from __future__ import annotations

from . import answer_queries, build_queries, read_queries, service_queries, structure_queries

_FAMILIES = (structure_queries, build_queries, read_queries, answer_queries, service_queries)

QUERIES = {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}
ORACLES = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
