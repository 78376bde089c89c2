"""Queries of composed searches, prompts, parsing and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import prompts as P
from lodestrand.functions.syntax import elements, grouped
from lodestrand.functions.text import layer
from lodestrand.operators import retrieval as T
from lodestrand.operators import search as S
from lodestrand.plans.graph_queries import SEEDS, edges, ents, rel, seeds
from lodestrand.plans.registry import Registry
from lodestrand.plans.search_queries import NOW, WORDS, chunks
from lodestrand.plans.table_queries import sources
from lodestrand.sources.tables import table

R = Registry()

R.add(
    "v_within_graph",
    lambda s, d: T.within_graph(chunks(s, d, "doc_id"), edges(s, d, ["calls", "contained_in"]), ents(s, d), seeds(s, d), 2).select("id"),
    f"""WITH RECURSIVE {NOW}, {SEEDS}, e AS (SELECT DISTINCT source_id AS here, target_id AS there FROM edges WHERE type IN ('calls', 'contained_in')),
reach AS (SELECT node, 0 AS depth FROM seeds UNION SELECT e.there, r.depth + 1 FROM reach r JOIN e ON e.here = r.node WHERE r.depth < 2)
SELECT id FROM now WHERE doc_id IN (SELECT doc_id FROM graph_entities WHERE doc_id <> '' AND id IN (SELECT node FROM reach))""",
)
R.add(
    "v_code_only",
    lambda s, d: T.code_only(chunks(s, d, "content_type", "language", "symbols", "element_name"), "python", "merge").select("id"),
    f"WITH {NOW} SELECT id FROM now WHERE lower(content_type) = 'code' AND lower(trim(language)) = 'python' AND (len(list_filter(symbols, lambda x: contains(lower(x), 'merge'))) > 0 OR contains(lower(element_name), 'merge'))",
)
R.add(
    "v_docs_only",
    lambda s, d: T.docs_only(chunks(s, d, "content_type", "language", "file_path")).select("id"),
    f"WITH {NOW} SELECT id FROM now WHERE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) IN ('md', 'rst', 'txt', 'adoc') OR lower(trim(language)) IN ('markdown', 'text') OR lower(content_type) IN ('documentation', 'prose') OR contains(lower(file_path), 'readme')",
)


def v_find_similar(spark: SparkSession, folder: str) -> DataFrame:
    e, c = ents(spark, folder), chunks(spark, folder, "file_path", "vector")
    one = e.filter(F.size("vector") == 64).orderBy("id").limit(1).select(F.col("vector").alias("wanted")).collect()  # one row
    vector = F.array(*(F.lit(float(x)) for x in one[0].wanted)) if one else F.array(F.lit(0.0))
    return T.find_similar(e, c, "mergeSlot", vector).select("id", "name", F.round("score", 6).alias("score"), "pass")


R.add("v_find_similar", v_find_similar)
R.add("p_context", lambda s, d: T.context({"code": S.fraction_search(T.code_only(chunks(s, d, "content", "content_type")), WORDS, 200), "docs": S.fraction_search(T.docs_only(chunks(s, d, "content", "content_type", "language", "file_path")), WORDS, 200)}, 8000, "code").select("id", "kind", "used"))
R.add("a_vector_clusters", lambda s, d: T.vector_clusters(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 8))
R.add(
    "g_layer_gaps",
    lambda s, d: T.layer_gaps(ents(s, d).filter("doc_id <> ''").select(layer(F.col("name"), F.lit(""), F.lit("")).alias("layer")), ["ui", "controller", "service", "repository", "entity", "database"]),
    """WITH t AS (SELECT lower(name) AS t FROM graph_entities WHERE doc_id <> ''),
l AS (SELECT DISTINCT CASE WHEN regexp_matches(t, 'component|view|template|page|form|\\.tsx|\\.jsx|\\.vue|\\.html|\\.jsp') THEN 'ui' WHEN regexp_matches(t, 'controller|handler|endpoint|resource|router|@restcontroller|@requestmapping') THEN 'controller'
  WHEN regexp_matches(t, 'service|manager|facade|orchestrator') THEN 'service' WHEN regexp_matches(t, 'repository|dao|mapper|store') THEN 'repository' WHEN regexp_matches(t, 'entity|model|domain|base|__tablename__') THEN 'entity'
  WHEN regexp_matches(t, 'table|column|schema|migration|\\.sql') THEN 'database' ELSE 'unknown' END AS layer FROM t)
SELECT * FROM (VALUES ('ui'), ('controller'), ('service'), ('repository'), ('entity'), ('database')) v(layer) WHERE layer NOT IN (SELECT layer FROM l)""",
)
R.add(
    "x_json_fields",
    lambda s, d: rel(s, d).select("id", P.json_fields(F.col("metadata"), ["line", "confidence"])["line"].alias("line")).distinct(),
    "SELECT DISTINCT id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.line') END AS line FROM graph_relationships",
)
_NAME_CASE = " ".join(f"WHEN name IN ({', '.join(repr(n) for n in names)}) THEN {v}" for v, names in P.FIRST_NAMES)
_TOP_CASE = " ".join(f"WHEN top IN ({', '.join(repr(n) for n in names)}) THEN {v}" for v, names in P.FIRST_FOLDERS)
R.add(
    "t_indexing_priority",
    lambda s, d: table(s, d, "file_states").select("file_path", P.indexing_priority(F.col("file_path")).alias("priority"), P.fast_path(F.col("file_path")).alias("fast")).distinct(),
    f"""WITH f AS (SELECT DISTINCT file_path, lower(string_split(file_path, '/')[-1]) AS name, lower(regexp_extract(file_path, '^([^/]*)/', 1)) AS top FROM file_states)
SELECT file_path, CASE WHEN starts_with(name, 'readme') THEN 1 {_NAME_CASE} {_TOP_CASE} ELSE 100 END AS priority,
  name IN ('readme.md', 'readme.rst', 'readme.txt', 'pyproject.toml', 'setup.py', 'package.json', 'cargo.toml', 'go.mod', 'main.py', 'app.py', 'index.py', '__main__.py', 'cli.py') OR top IN ('api', 'routes', 'endpoints', 'core', 'src', 'lib') AS fast FROM f""",
)
_CLEAN = "regexp_replace(regexp_replace({c}, '(?s)<[^>]+>.*?</[^>]+>', '', 'g'), '<[^>]+/>', '', 'g')"
_SIGNALS = f"""c AS (SELECT id, {_CLEAN.format(c="coalesce(text, '')")} AS c FROM {{rows}}),
f AS (SELECT id, list_sort(list_distinct(regexp_extract_all(c, '[A-Z][a-z]+(?:[A-Z][a-z]+)+') || regexp_extract_all(c, '[A-Z][A-Z_]{{{{2,}}}}') || list_filter(regexp_extract_all(c, '[a-z]+_[a-z_]+'), lambda x: length(x) > 4)
    || regexp_extract_all(c, '["'']([^"'']{{{{2,}}}})["'']', 1))) AS entities, list_sort(list_distinct(regexp_extract_all(c, '[\\w/.-]+\\.\\w{{{{1,8}}}}'))) AS paths,
  CASE {' '.join(f"WHEN regexp_matches(c, '{p}') THEN '{n}'" for n, p in P.INTENTS)} ELSE 'GENERAL' END AS intent, regexp_matches(c, '{P.URGENCY}') AS urgent, regexp_matches(c, '{P.RECALL}') AS recall FROM c),
s AS (SELECT *, CASE WHEN len(entities) > 0 THEN 30 ELSE 0 END + CASE WHEN len(paths) > 0 THEN 25 ELSE 0 END + CASE WHEN intent IN ('CODE', 'ARCHITECTURAL') THEN 20 ELSE 0 END + CASE WHEN urgent THEN 10 ELSE 0 END + CASE WHEN recall THEN 15 ELSE 0 END AS score FROM f)
SELECT id AS {{key}}, score, CASE WHEN score >= 70 THEN 'FULL_PACKET' WHEN score >= 40 THEN 'RELATED_LINKS' WHEN score >= 20 THEN 'MEMORY_ONLY' ELSE 'NONE' END AS tier, intent, array_to_string(entities, '|') AS entities, array_to_string(paths, '|') AS paths, urgent, recall FROM s"""


def _signals(rows: DataFrame, key: str) -> DataFrame:
    told = rows.select(key, P.prompt_signals(F.col("text")).alias("p"))
    return told.select(key, "p.score", "p.tier", "p.intent", F.array_join("p.entities", "|").alias("entities"), F.array_join("p.file_paths", "|").alias("paths"), F.col("p.has_urgency").alias("urgent"), F.col("p.has_recall").alias("recall"))


R.add("x_prompt_signals", lambda s, d: _signals(table(s, d, "eval_items"), "item_id"), "WITH " + _SIGNALS.format(rows="(SELECT item_id AS id, text FROM eval_items)", key="item_id").replace("{{", "{").replace("}}", "}"))
R.add("x_prompt_tier", lambda s, d: _signals(table(s, d, "documents").filter("doc_kind = 'session_memo'"), "doc_id"), "WITH " + _SIGNALS.format(rows="(SELECT doc_id AS id, text FROM documents WHERE doc_kind = 'session_memo')", key="doc_id").replace("{{", "{").replace("}}", "}"))


def r_pivots(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose words leave the topic of the one before in their source; 20 words of each are enough for that."""
    rows = table(spark, folder, "documents").select("doc_id", "source", F.col("created_at").cast("timestamp").alias("at"), P.prompt_keywords(F.coalesce("text", F.lit(""))).alias("words"))
    before = F.lag("words").over(Window.partitionBy("source").orderBy("at", "doc_id"))
    return rows.withColumn("before", before).select("doc_id", P.pivoted(F.col("words"), F.col("before")).alias("pivot"))


_WORDLESS = ", ".join(f"'{w}'" for w in P.PROMPT_STOP_WORDS)
R.add(
    "r_pivots",
    r_pivots,
    f"""WITH k AS (SELECT doc_id, source, created_at, list_distinct(list_filter(regexp_extract_all(lower({_CLEAN.format(c="coalesce(text, '')")}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN ({_WORDLESS}))[1:20]) AS k FROM documents),
l AS (SELECT *, lag(k) OVER (PARTITION BY source ORDER BY created_at, doc_id) AS b FROM k)
SELECT doc_id, b IS NOT NULL AND len(b) > 0 AND len(k) > 0 AND len(list_intersect(k, b)) / nullif(len(list_distinct(k || b)), 0) < 0.3 AS pivot FROM l""",
)
R.add("s_elements", lambda s, d: elements(sources(s, d)).select("path", "element_type", "element_name", "line_start", "line_end", "parent", F.array_join("calls", ",").alias("calls")))
R.add("s_grouped", lambda s, d: grouped(elements(sources(s, d))))

QUERIES, ORACLES = R.queries, R.oracles
