"""Queries of the hierarchy operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrand.operators.hierarchy import containment_links, descendants, hierarchy
from lodestrand.sources.tables import table

_LINKS = """
given AS (
  SELECT parent, child FROM (
    SELECT CASE WHEN lower(trim(type)) = 'contains' THEN source_id ELSE target_id END AS parent,
           CASE WHEN lower(trim(type)) = 'contains' THEN target_id ELSE source_id END AS child
    FROM graph_relationships WHERE lower(trim(type)) IN ('contains', 'contained_in')
  ) WHERE trim(parent) <> '' AND trim(child) <> ''
),
links AS (SELECT child AS node, min(parent) AS up FROM given GROUP BY child),
roots AS (SELECT DISTINCT parent AS node FROM given WHERE parent NOT IN (SELECT node FROM links)),
down AS (
  SELECT node AS node_id, node AS root_id, 0 AS depth, [node] AS path FROM roots
  UNION ALL
  SELECT l.node, d.root_id, d.depth + 1, list_append(d.path, l.node) FROM down d JOIN links l ON l.up = d.node_id
),
lost AS (SELECT node, up FROM links WHERE node NOT IN (SELECT node_id FROM down)),
chase AS (
  SELECT node, up AS above FROM lost
  UNION
  SELECT c.node, l.up FROM chase c JOIN lost l ON l.node = c.above
),
full_tree AS (
  SELECT node_id, root_id, depth, path FROM down
  UNION ALL
  SELECT node, '', CASE WHEN node IN (SELECT node FROM chase WHERE node = above) THEN -1 ELSE -2 END, CAST([] AS VARCHAR[]) FROM lost
)"""


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return containment_links(table(spark, folder, "graph_relationships"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every id that occurs in a containment link."""
    return hierarchy(_links(spark, folder), paths=False).select("node_id", "root_id", "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path, depth and root of every id that occurs in a containment link."""
    return hierarchy(_links(spark, folder))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every id that occurs in a containment link."""
    return descendants(hierarchy(_links(spark, folder)))


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

ORACLES = {
    "p5_found": f"WITH RECURSIVE {_LINKS} SELECT node_id, root_id, depth FROM full_tree",
    "p5_paths": f"WITH RECURSIVE {_LINKS} SELECT node_id, root_id, depth, path FROM full_tree",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS},
pairs AS (SELECT unnest(path[:-2]) AS up, node_id FROM full_tree),
lists AS (SELECT up, count(*) AS n, list_sort(list(node_id)) AS d FROM pairs GROUP BY up)
SELECT t.node_id, CAST(coalesce(n, 0) AS BIGINT) AS n_descendants, 0 AS block, coalesce(d, CAST([] AS VARCHAR[])) AS descendants
FROM full_tree t LEFT JOIN lists ON lists.up = t.node_id""",
}
