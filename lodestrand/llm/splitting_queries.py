"""Queries of the operator that cuts oversized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.splitting import LIMIT, oversized_pieces
from lodestrand.sources.tables import current_rows, table


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the current chunks over 1,500 characters. Contents that aren't long don't cross the shuffle."""
    rows = table(spark, folder, "document_chunks").select("id", "indexed_at", "line_start", "line_end", F.when(F.length("content") > LIMIT, F.col("content")).alias("content"))
    return oversized_pieces(current_rows(rows))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current chunks over 1,500 characters with the coarsest unit that fits."""
    return p1_pieces(spark, folder).filter("piece = 0").select("id", "boundary")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

ORACLES = {
    "p1_found": """
WITH now AS (
  SELECT id, content FROM document_chunks
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1
),
long AS (SELECT id, content, string_split(content, chr(10)) AS l FROM now WHERE length(content) > 1500),
lines AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM long),
runs AS (
  SELECT id, line, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank,
    sum(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM lines
),
paragraphs AS (SELECT id, sum(length(line) + 1) - 1 AS n FROM runs WHERE NOT blank GROUP BY id, run),
most AS (
  SELECT long.id, coalesce((SELECT max(n) FROM paragraphs p WHERE p.id = long.id), 0) AS paragraph,
    list_max(list_transform(l, lambda x: length(x))) AS line,
    coalesce(list_max(list_transform(regexp_split_to_array(content, '\\s+'), lambda x: length(x))), 0) AS word
  FROM long
)
SELECT id, CASE WHEN paragraph <= 1500 THEN 'paragraph' WHEN line <= 1500 THEN 'line' WHEN word <= 1500 THEN 'word' ELSE 'char' END AS boundary
FROM most""",
}
