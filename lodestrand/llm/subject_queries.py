"""Queries of the subject model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.subjects import SubjectModel
from lodestrand.sources.tables import table


def _model(spark: SparkSession, folder: str) -> SubjectModel:
    subjects = [r.subject for r in table(spark, folder, "subject_areas").orderBy("subject_id").collect()]  # a fixed small table
    return SubjectModel(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "subject_labels").select("doc_id", "subject"), subjects)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that each document with readable text is about."""
    return _model(spark, folder).chosen()


def p9_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject's share of a document's evidence, with its calibrated posterior."""
    return _model(spark, folder).posteriors()


QUERIES = {"p9_found": p9_found, "p9_posteriors": p9_posteriors}
ORACLES: dict[str, str] = {}
