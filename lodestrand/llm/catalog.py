"""All queries of this subpackage, with their SQL where there is any."""

from __future__ import annotations

from lodestrand.llm import documented_queries, leak_queries, near_copy_queries, neighbour_queries, packing_queries, provenance_queries, splitting_queries, subject_queries

MODULES = [splitting_queries, neighbour_queries, provenance_queries, near_copy_queries, documented_queries, packing_queries, leak_queries, subject_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
