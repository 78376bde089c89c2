"""All queries of the core, with their SQL."""

from __future__ import annotations

from lodestrand.plans import event_queries, graph_queries, hierarchy_queries, retrieval_queries, search_queries, table_queries, text_queries, upkeep_queries

MODULES = [hierarchy_queries, search_queries, graph_queries, event_queries, text_queries, table_queries, retrieval_queries, upkeep_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
