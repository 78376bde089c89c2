"""Queries of the search for evaluation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.leaks import leaks
from lodestrand.sources.tables import table


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds part of an evaluation item, with how much of it."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items they hold."""
    return p8_leaks(spark, folder).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}

_RUNS = """
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
item_runs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item_words)
),
own AS (SELECT run, min(item_id) AS item_id FROM item_runs GROUP BY run HAVING count(*) = 1),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
),
hits AS (SELECT doc_id, item_id, count(*) AS n FROM runs JOIN own USING (run) GROUP BY ALL)"""

ORACLES = {
    "p8_found": _RUNS + " SELECT doc_id, item_id FROM hits",
    "p8_leaks": _RUNS
    + """ SELECT doc_id, hits.item_id, CAST(n AS INTEGER) AS windows, n / total AS share FROM hits
JOIN (SELECT item_id, count(*) AS total FROM own GROUP BY item_id) t ON t.item_id = hits.item_id""",
}
