"""Graph, lineage and resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import entity_type, inverse_type, layer, personal
from lodestrand.operators import graph as G
from lodestrand.plans.registry import Registry
from lodestrand.sources.tables import table

R = Registry()
EDGES = "edges AS (SELECT DISTINCT source_id, target_id, lower(trim(type)) AS type FROM graph_relationships WHERE source_id <> '' AND target_id <> '')"
#: Seeds of the walks: the three most called entities.
SEEDS = f"""{EDGES}, seeds AS (SELECT target_id AS node FROM edges WHERE type = 'calls' GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 3)"""


def rel(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_relationships")


def ents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_entities")


def edges(spark: SparkSession, folder: str, types: list[str] | None = None) -> DataFrame:
    return G.clean_edges(rel(spark, folder), types)


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    calls = edges(spark, folder, ["calls"]).groupBy(F.col("target_id").alias("node")).agg(F.count("*").alias("n"))
    return calls.orderBy(F.desc("n"), "node").limit(3).select("node")


_CALLS = "e AS (SELECT DISTINCT source_id AS here, target_id AS there FROM edges WHERE type = 'calls')"
_REACH = f"""{SEEDS}, {_CALLS},
reach AS (
  SELECT node, 0 AS depth FROM seeds UNION SELECT {{to}}, r.depth + 1 FROM reach r JOIN e ON {{at}} = r.node WHERE r.depth < {{most}}
),
nodes AS (SELECT node, min(depth) AS depth FROM reach GROUP BY node)"""
_BACK, _OUT = _REACH.format(to="e.here", at="e.there", most=3), _REACH.format(to="e.there", at="e.here", most=2)
R.add("g_reach_in", lambda s, d: G.reach(edges(s, d, ["calls"]), seeds(s, d), 3, "in").select("node", "depth"), f"WITH RECURSIVE {_BACK} SELECT node, depth FROM nodes")
R.add(
    "g_bfs_tree",
    lambda s, d: G.reach(edges(s, d, ["calls"]), seeds(s, d), 3, "in"),
    f"WITH RECURSIVE {_BACK} SELECT n.node, n.depth, min(p.node) AS parent FROM nodes n LEFT JOIN e ON e.here = n.node AND n.depth > 0 LEFT JOIN nodes p ON p.node = e.there AND p.depth = n.depth - 1 GROUP BY n.node, n.depth",
)
R.add(
    "g_traverse",
    lambda s, d: G.traverse(edges(s, d, ["calls"]), seeds(s, d), 2).select("here", "there", "type", "way", "step"),
    f"WITH RECURSIVE {_OUT} SELECT here, there, 'calls' AS type, 'out' AS way, depth + 1 AS step FROM e JOIN nodes ON node = here WHERE depth < 2",
)
R.add(
    "g_paths",
    lambda s, d: G.paths(edges(s, d, ["calls"]), seeds(s, d), 2, "in").select("seed", "node", "depth", F.array_join("path", " > ").alias("path")),
    f"""WITH RECURSIVE {SEEDS}, {_CALLS},
p AS (SELECT node AS seed, node, 0 AS depth, [node] AS path FROM seeds
  UNION ALL SELECT p.seed, e.here, p.depth + 1, list_append(p.path, e.here) FROM p JOIN e ON e.there = p.node WHERE p.depth < 2 AND NOT list_contains(p.path, e.here))
SELECT seed, node, depth, array_to_string(path, ' > ') AS path FROM p""",
)
_ABOUT = "about AS (SELECT id, (min({'name': name, 'type': type, 'file_path': file_path})) AS e FROM graph_entities GROUP BY id)"
_PERSONAL = "regexp_matches(lower(a.e.name), 'email|phone|ssn|address|name|password|credit_card|dob|birth|social_security|passport|license')"
R.add("g_lineage", lambda s, d: G.lineage(edges(s, d, ["calls", "contains"]), ents(s, d), seeds(s, d), 3, "in"))
R.add(
    "g_impact",
    lambda s, d: G.impact(edges(s, d, ["calls"]), ents(s, d), seeds(s, d), 3),
    f"""WITH RECURSIVE {_BACK}, {_ABOUT},
x AS (SELECT coalesce(a.e.file_path, '') AS file_path, count(*) AS affected, min(depth) AS nearest, count(*) FILTER ({_PERSONAL}) AS p FROM nodes n LEFT JOIN about a ON a.id = n.node WHERE depth > 0 GROUP BY 1)
SELECT file_path, affected, nearest, CASE WHEN p > 0 THEN 'critical' WHEN affected >= 20 THEN 'high' WHEN affected >= 5 THEN 'medium' ELSE 'low' END AS risk FROM x""",
)
R.add("g_cycles", lambda s, d: G.cycles(edges(s, d, ["calls", "references", "imports"]), 6))
R.add(
    "g_edge_confidence",
    lambda s, d: rel(s, d).select("id", G.edge_confidence(F.col("metadata"), F.lower(F.trim("type"))).alias("confidence")).distinct(),
    """WITH c AS (SELECT id, lower(trim(type)) AS type,
  CASE WHEN json_valid(metadata) THEN try_cast(coalesce(json_extract_string(metadata, '$.confidence'), json_extract_string(metadata, '$.resolution_confidence')) AS DOUBLE) END AS c FROM graph_relationships)
SELECT DISTINCT id, CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' WHEN c >= 0.5 THEN 'low' WHEN c IS NOT NULL THEN 'inferred'
  WHEN type IN ('defines', 'contains', 'inherits') THEN 'high' WHEN type IN ('calls', 'imports', 'references') THEN 'medium' ELSE 'low' END AS confidence FROM c""",
)
R.add(
    "g_layers",
    lambda s, d: ents(s, d).select("id", layer(F.col("name"), F.col("type"), F.col("file_path")).alias("layer"), personal(F.col("name")).alias("personal")).distinct(),
    """WITH t AS (SELECT id, lower(name) AS n, lower(coalesce(name, '') || ' ' || coalesce(type, '') || ' ' || coalesce(file_path, '')) AS t FROM graph_entities)
SELECT DISTINCT id, CASE WHEN regexp_matches(t, 'component|view|template|page|form|\\.tsx|\\.jsx|\\.vue|\\.html|\\.jsp') THEN 'ui'
  WHEN regexp_matches(t, 'controller|handler|endpoint|resource|router|@restcontroller|@requestmapping') THEN 'controller' WHEN regexp_matches(t, 'service|manager|facade|orchestrator') THEN 'service'
  WHEN regexp_matches(t, 'repository|dao|mapper|store') THEN 'repository' WHEN regexp_matches(t, 'entity|model|domain|base|__tablename__') THEN 'entity'
  WHEN regexp_matches(t, 'table|column|schema|migration|\\.sql') THEN 'database' ELSE 'unknown' END AS layer,
  regexp_matches(n, 'email|phone|ssn|address|name|password|credit_card|dob|birth|social_security|passport|license') AS personal FROM t""",
)
R.add("g_types", lambda s, d: ents(s, d).select(entity_type(F.col("type")).alias("type")).groupBy("type").count().withColumnRenamed("count", "n"), "SELECT regexp_replace(lower(trim(type)), '^code_', '') AS type, count(*) AS n FROM graph_entities GROUP BY 1")
R.add(
    "g_inverse",
    lambda s, d: edges(s, d).select("type", inverse_type(F.col("type")).alias("inverse")).distinct(),
    f"""WITH {EDGES} SELECT DISTINCT type, CASE type WHEN 'calls' THEN 'called_by' WHEN 'imports' THEN 'imported_by' WHEN 'contains' THEN 'contained_in' WHEN 'contained_in' THEN 'contains' WHEN 'inherits' THEN 'inherited_by'
  WHEN 'references' THEN 'referenced_by' WHEN 'defines' THEN 'defined_in' WHEN 'tests' THEN 'tested_by' WHEN 'similar_to' THEN 'similar_to' END AS inverse FROM edges""",
)
R.add("g_relationship_ids", lambda s, d: edges(s, d).select("source_id", "target_id", "type", G.relationship_id("source_id", "target_id", "type").alias("key")), f"WITH {EDGES} SELECT source_id, target_id, type, substring(sha256(source_id || '|' || target_id || '|' || type), 1, 16) AS key FROM edges")
R.add("g_external", lambda s, d: ents(s, d).filter("id like 'external::%'").select("id", G.external_kind(F.col("name"), F.lower("type")).alias("kind")).distinct(),
      """SELECT DISTINCT id, CASE WHEN contains(lower(type), 'module') THEN 'module' WHEN contains(lower(type), 'class') OR regexp_matches(name, '^[A-Z][a-z]') THEN 'class'
  WHEN contains(lower(name), 'test') OR contains(lower(name), 'mock') THEN 'test' WHEN contains(lower(type), 'function') THEN 'function' ELSE 'symbol' END AS kind FROM graph_entities WHERE id LIKE 'external::%'""")  # fmt: skip
_NAMED = "named AS (SELECT id, min({'name': name, 'type': type}) AS e FROM graph_entities GROUP BY id)"
R.add("j_dependencies", lambda s, d: G.dependencies(rel(s, d), ents(s, d), ["calls", "imports"]), f"WITH {EDGES}, {_NAMED} SELECT source_id, edges.type AS type, target_id, e.name AS target_name, regexp_replace(lower(trim(e.type)), '^code_', '') AS target_type FROM edges JOIN named ON named.id = target_id WHERE edges.type IN ('calls', 'imports')")
R.add("j_usages", lambda s, d: G.usages(rel(s, d), ents(s, d), ["tests"]), f"WITH {EDGES}, {_NAMED} SELECT target_id, edges.type AS type, source_id, e.name AS source_name FROM edges JOIN named ON named.id = source_id WHERE edges.type = 'tests'")
R.add(
    "j_broken_links",
    lambda s, d: G.broken_links(rel(s, d), ents(s, d)),
    f"""WITH {EDGES}, k AS (SELECT DISTINCT id FROM graph_entities),
x AS (SELECT edges.*, s.id IS NULL AS a, t.id IS NULL AS b FROM edges LEFT JOIN k s ON s.id = source_id LEFT JOIN k t ON t.id = target_id)
SELECT source_id, target_id, type, CASE WHEN a AND b THEN 'both' WHEN a THEN 'source' ELSE 'target' END AS missing FROM x WHERE a OR b""",
)
R.add("j_isolated", lambda s, d: G.isolated(ents(s, d), rel(s, d)), f"WITH {EDGES} SELECT DISTINCT id FROM graph_entities WHERE id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)")


def _references(spark: SparkSession, folder: str, typed: bool) -> DataFrame:
    """Calls by the name (and type) of what they call and the file of the caller, as if the target weren't known yet."""
    e = ents(spark, folder)
    named = G.one_row_each(e, "name", "type").select(F.col("id").alias("target_id"), "name", F.col("type").alias("kind"))
    placed = G.one_row_each(e, "file_path").select(F.col("id").alias("source_id"), "file_path")
    calls = edges(spark, folder, ["calls"]).join(named, "target_id").join(placed, "source_id")
    kind = F.col("kind") if typed else F.lit(None).cast("string")
    return calls.select(G.relationship_id("source_id", "target_id").alias("ref_id"), "name", kind.alias("type"), F.lit(None).cast("string").alias("import_path"), "file_path").distinct()


def imports_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """How often a name is imported: name, n."""
    named = G.one_row_each(ents(spark, folder), "name").select(F.col("id").alias("target_id"), "name")
    return edges(spark, folder, ["imports"]).join(named, "target_id").groupBy("name").agg(F.count("*").alias("n"))


def _resolved(typed: bool):
    return lambda s, d: G.resolve_references(_references(s, d, typed), ents(s, d), imports_by_name(s, d))


R.add("j_resolve_references", lambda s, d: _resolved(False)(s, d).select("ref_id", "entity_id", "strategy", F.round("score", 6).alias("score")))
_KIND = "regexp_replace(lower(trim({})), '^code_', '')"
_EXACT = f"""one AS (SELECT id, min({{'name': name, 'type': type}}) AS e FROM graph_entities GROUP BY id), file AS (SELECT id, min(file_path) AS file_path FROM graph_entities GROUP BY id),
often AS (SELECT e.name AS name, count(*) AS n FROM edges JOIN one ON one.id = target_id WHERE edges.type = 'imports' GROUP BY 1),
kinds AS (SELECT e.name AS name, {_KIND.format('e.type')} AS kind, count(*) AS same, min(id) AS entity_id FROM one WHERE e.name <> '' GROUP BY ALL),
refs AS (SELECT DISTINCT substring(sha256(source_id || '|' || target_id), 1, 16) AS ref_id, e.name AS name, {_KIND.format('e.type')} AS kind FROM edges JOIN one ON one.id = target_id JOIN file ON file.id = source_id WHERE edges.type = 'calls'),
got AS (SELECT ref_id, entity_id, CASE WHEN same = 1 THEN 1.0 WHEN n > 0 THEN 0.7 + 0.2 / same END AS score FROM refs JOIN kinds USING (name, kind) LEFT JOIN often USING (name))"""
R.add("j_resolve_exact", lambda s, d: _resolved(True)(s, d).filter("strategy = 'exact_match'").select("ref_id", "entity_id", F.round("score", 6).alias("score")), f"WITH {EDGES}, {_EXACT} SELECT ref_id, entity_id, round(score, 6) AS score FROM got WHERE score IS NOT NULL")
R.add("a_resolution", lambda s, d: G.resolution_statistics(_resolved(True)(s, d).filter("strategy = 'exact_match'")).select("strategy", "references", F.round("score", 6).alias("score")), f"WITH {EDGES}, {_EXACT} SELECT 'exact_match' AS strategy, count(*) AS \"references\", round(avg(score), 6) AS score FROM got WHERE score IS NOT NULL")
_SNAKE = "regexp_replace(regexp_replace(lower(replace(regexp_replace(regexp_replace({c}, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '-', '_')), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
_HERE = "src/core/merge/slot_query.py"
R.add(
    "x_path_scores",
    lambda s, d: ents(s, d).filter("file_path <> ''").select("name", "file_path", F.round(G.path_proximity(F.lit(_HERE), F.col("file_path")), 6).alias("near"), G.naming_score(F.col("name"), F.col("file_path")).alias("naming"), G.folder_score(F.col("name"), F.col("file_path")).alias("folders")).distinct(),
    f"""WITH e AS (SELECT DISTINCT name, file_path, string_split(file_path, '/') AS p, string_split('{_HERE}', '/') AS h FROM graph_entities WHERE file_path <> ''),
c AS (SELECT *, len(list_filter(range(1, least(len(p), len(h)) + 1), lambda i: p[1:i] = h[1:i])) AS common, {_SNAKE.format(c='name')} AS a, {_SNAKE.format(c="regexp_replace(p[-1], '(.)[.][^.]*$', '\\1')")} AS b FROM e),
f AS (SELECT name, file_path, unnest(p[1:len(p) - 1]) AS part, unnest(range(1, len(p))) AS i, len(p) - 1 AS last, a FROM c),
g AS (SELECT *, {_SNAKE.format(c='part')} AS b FROM f),
s AS (SELECT name, file_path, sum(CASE WHEN a = b THEN CASE WHEN i = last THEN 30 ELSE 20 END WHEN contains(b, a) OR contains(a, b) THEN 10 ELSE 0 END + 5 * len(list_intersect(list_distinct(string_split(a, '_')), list_distinct(string_split(b, '_'))))) AS folders FROM g GROUP BY ALL)
SELECT c.name, c.file_path, round(CASE WHEN c.file_path = '{_HERE}' THEN 1.0 WHEN regexp_replace(c.file_path, '/?[^/]*$', '') = 'src/core/merge' THEN 0.8 ELSE greatest(0.3, 1 - 0.1 * (len(p) + len(h) - 2 * common)) END, 6) AS near,
  CAST(CASE WHEN a = b THEN 100 ELSE CASE WHEN contains(b, a) THEN 50 ELSE 0 END + CASE WHEN contains(a, b) THEN 30 ELSE 0 END + 10 * len(list_intersect(list_distinct(string_split(a, '_')), list_distinct(string_split(b, '_')))) END AS DOUBLE) AS naming,
  CAST(coalesce(folders, 0) AS DOUBLE) AS folders FROM c LEFT JOIN s ON s.name = c.name AND s.file_path = c.file_path""",
)
R.add(
    "g_resolve_entity",
    lambda s, d: G.resolve_entity(ents(s, d), "mergeSlot", limit=20, fuzzy=None).select("id", "tier"),
    """WITH e AS (SELECT id, (min({'name': name, 'type': type, 'file_path': file_path})).name AS name FROM graph_entities GROUP BY id),
t AS (SELECT id, name, CASE WHEN name = 'mergeSlot' THEN 1 WHEN lower(name) = 'mergeslot' THEN 2
  WHEN array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[\\s_.\\-]+'), lambda w: w <> ''), ' ') = 'merge slot' THEN 3
  WHEN contains(lower(name), 'mergeslot') THEN 4 END AS tier FROM e)
SELECT id, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, length(name), id LIMIT 20""",
)
R.add("g_fuzzy_entity", lambda s, d: G.resolve_entity(ents(s, d), "mergeSlotQuery", limit=20).select("id", "tier"))
R.add("g_suggestions", lambda s, d: G.suggestions(ents(s, d), "mergeSlotQuery").select("name", F.round("ratio", 6).alias("ratio")))
R.add(
    "u_compare_types",
    lambda s, d: (lambda e: e.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")))(rel(s, d).select("project_id", F.lower(F.trim("type")).alias("type"))),
    "SELECT project_id, string_agg(DISTINCT lower(trim(type)), ',' ORDER BY lower(trim(type))) AS types FROM graph_relationships GROUP BY project_id",
)

QUERIES, ORACLES = R.queries, R.oracles
