"""Queries of the operator that tells files nobody here wrote by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.provenance import provenance, source_files
from lodestrand.sources.tables import table


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """Facts, family and verdict of every source file."""
    return provenance(source_files(table(spark, folder, "document_chunks")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source files that are generated, minified, third-party or data stored as code."""
    return p3_files(spark, folder).filter("verdict is not null").select("doc_id")


QUERIES = {"p3_found": p3_found, "p3_files": p3_files}
ORACLES: dict[str, str] = {}
