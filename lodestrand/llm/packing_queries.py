"""Queries of the operator that fills containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.packing import pack, token_lengths
from lodestrand.sources.tables import table


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    return pack(token_lengths(table(spark, folder, "documents")))


QUERIES = {"p7_packed": p7_packed}
ORACLES: dict[str, str] = {}
