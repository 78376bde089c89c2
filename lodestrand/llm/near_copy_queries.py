"""Queries of the near-copy operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm.near_copies import NearCopies
from lodestrand.sources.tables import current_rows, table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "document_chunks").select("id", "indexed_at", "content")).select("id", "content")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current chunks that share at least half of their runs of three words."""
    return NearCopies(_chunks(spark, folder), width=3, threshold=0.5).pairs()


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class, links and group of every current chunk: five words, similarity of 0.8 or more."""
    return NearCopies(_chunks(spark, folder)).groups()


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}

_SHINGLES = """
WITH RECURSIVE now AS (
  SELECT id, content FROM document_chunks
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1
),
words AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM now),
shingles AS (
  SELECT DISTINCT id, array_to_string(w[i:i + {last}], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - {last} + 1)) AS i FROM words)
),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
pairs AS (
  SELECT a.id AS id_1, b.id AS id_2, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY ALL
),
found AS (
  SELECT id_1, id_2, shared / (x.n + y.n - shared) AS similarity FROM pairs JOIN sizes x ON x.id = id_1 JOIN sizes y ON y.id = id_2
  WHERE shared / (x.n + y.n - shared) >= {least}
)"""

ORACLES = {
    "p4_found": _SHINGLES.format(last=2, least=0.5) + " SELECT id_1, id_2 FROM found",
    "p4_groups": _SHINGLES.format(last=4, least=0.8)
    + """,
both_ways AS (SELECT id_1 AS a, id_2 AS b, similarity FROM found UNION ALL SELECT id_2, id_1, similarity FROM found),
same AS (
  SELECT id, least(id, coalesce(min(b) FILTER (similarity = 1), id)) AS leader, 1 + count(b) FILTER (similarity = 1) AS size
  FROM sizes LEFT JOIN both_ways ON a = id GROUP BY id
),
linked AS (
  SELECT x.leader AS id, count(DISTINCT y.leader) AS links FROM both_ways JOIN same x ON x.id = a JOIN same y ON y.id = b
  WHERE x.leader <> y.leader GROUP BY x.leader
),
reach AS (SELECT id, id AS other FROM sizes UNION SELECT r.id, b FROM reach r JOIN both_ways ON a = r.other)
SELECT s.id, leader, size, coalesce(links, 0) AS links, g.group_id FROM same s LEFT JOIN linked ON linked.id = leader
JOIN (SELECT id, min(other) AS group_id FROM reach GROUP BY id) g ON g.id = s.id""",
}
