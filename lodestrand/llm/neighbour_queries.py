"""Queries of the operator that finds the most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.neighbours import Neighbours
from lodestrand.sources.tables import current_rows, table


def _tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    chunks = current_rows(table(spark, folder, "document_chunks").select("id", "indexed_at", "vector")).select("id", "vector")
    return [chunks, table(spark, folder, "graph_entities").select("id", "vector")]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of ids of one table with a similarity of at least 0.9, one among the five most similar of the other."""
    pairs = None
    for df in _tables(spark, folder):
        found = Neighbours(df).pairs(least=0.9)
        found = found.select(F.least("id", "neighbour").alias("id_1"), F.greatest("id", "neighbour").alias("id_2"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar ids of every id of document_chunks and of graph_entities."""
    chunks, entities = (Neighbours(df).pairs() for df in _tables(spark, folder))
    return chunks.withColumn("table", F.lit("document_chunks")).unionByName(entities.withColumn("table", F.lit("graph_entities")))


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
ORACLES: dict[str, str] = {}
