"""Queries of the operator that pairs functions with their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.documented import documented_functions
from lodestrand.sources.tables import table


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and cleaned documentation of every function and method that has any worth the name."""
    return documented_functions(table(spark, folder, "graph_entities"), table(spark, folder, "document_chunks"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the functions and methods whose docstring is neither missing nor trivial."""
    return p6_pairs(spark, folder).select("id")


QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs}
ORACLES: dict[str, str] = {}
