"""Queries of sources and of table maintenance, on the chunks as files and on the file states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import graph as G
from lodestrand.plans.registry import Registry
from lodestrand.plans.search_queries import NOW, chunks
from lodestrand.sources import files as S
from lodestrand.sources import sinks as K
from lodestrand.sources.tables import table

R = Registry()


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Files: the current chunks of a file joined in order, path (with its project before it), text, language by the suffix."""
    rows = chunks(spark, folder, "project_id", "file_path", "chunk_index", "content")
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "id", "content")))
    files = rows.groupBy("project_id", "file_path").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("text"))
    return files.select(F.concat_ws("/", "project_id", "file_path").alias("path"), "text", T.language(F.col("file_path")).alias("language"))


def states(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_states")


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Older and newer states, parted at a time."""
    rows, cut = states(spark, folder), F.lit("2024-09-01").cast("timestamp")
    return S.latest_states(rows.filter(F.col("last_updated").cast("timestamp") < cut)), S.latest_states(rows.filter(F.col("last_updated").cast("timestamp") >= cut))


R.add("s_latest_states", lambda s, d: S.latest_states(states(s, d)).select("project_id", "file_path", "content_hash"), """SELECT project_id, file_path, content_hash FROM file_states
QUALIFY row_number() OVER (PARTITION BY project_id, file_path ORDER BY last_updated DESC, content_hash DESC NULLS LAST) = 1""")  # fmt: skip
R.add(
    "r_changes",
    lambda s, d: S.changes(*_halves(s, d)),
    """WITH l AS (SELECT project_id, file_path, content_hash, last_updated < TIMESTAMPTZ '2024-09-01 00:00:00+00' AS old FROM file_states
  QUALIFY row_number() OVER (PARTITION BY project_id, file_path, last_updated < TIMESTAMPTZ '2024-09-01 00:00:00+00' ORDER BY last_updated DESC, content_hash DESC NULLS LAST) = 1),
a AS (SELECT * FROM l WHERE old), b AS (SELECT * FROM l WHERE NOT old),
c AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.file_path, b.file_path) AS file_path,
  CASE WHEN a.project_id IS NULL THEN 'added' WHEN b.project_id IS NULL THEN 'deleted' WHEN coalesce(a.content_hash <> b.content_hash, true) THEN 'changed' END AS change
  FROM a FULL JOIN b ON a.project_id = b.project_id AND a.file_path = b.file_path)
SELECT * FROM c WHERE change IS NOT NULL""",
)


def k_upsert(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _halves(spark, folder)
    return K.merged(old, new, ["project_id", "file_path"]).select("project_id", "file_path", F.unix_micros(F.col("last_updated").cast("timestamp")).alias("updated"))


R.add("k_upsert", k_upsert, "SELECT project_id, file_path, epoch_us(max(last_updated)) AS updated FROM file_states GROUP BY 1, 2")
R.add("k_last_of_key", lambda s, d: K.last_of_key(table(s, d, "events"), ["user_id"], "event_id").select("user_id", "event_id"), "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
R.add(
    "k_delete_by_ids",
    lambda s, d: K.without_ids(table(s, d, "documents"), table(s, d, "subject_labels").select(F.col("doc_id").alias("id")), "doc_id").select("doc_id"),
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels)",
)
R.add(
    "k_delete_files",
    lambda s, d: K.without_files(states(s, d), ["src/a.py"], "briarmill").groupBy("project_id").agg(F.count("*").alias("n")),
    "SELECT project_id, count(*) AS n FROM file_states WHERE NOT (project_id = 'briarmill' AND file_path = 'src/a.py') GROUP BY 1",
)
R.add(
    "k_delete_cascade",
    lambda s, d: K.without_entities(table(s, d, "graph_entities"), table(s, d, "graph_relationships"), table(s, d, "graph_entities").filter("id like 'external::%'").select("id"))[1].groupBy("project_id").agg(F.count("*").alias("n")),
    """WITH x AS (SELECT DISTINCT id FROM graph_entities WHERE id LIKE 'external::%')
SELECT project_id, count(*) AS n FROM graph_relationships r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = r.source_id) AND NOT EXISTS (SELECT 1 FROM x WHERE x.id = r.target_id) GROUP BY 1""",
)
R.add(
    "k_update",
    lambda s, d: K.updated(table(s, d, "documents"), F.col("lang").isNull(), {"lang": F.lit("und")}).groupBy("lang").agg(F.count("*").alias("n")),
    "SELECT coalesce(lang, 'und') AS lang, count(*) AS n FROM documents GROUP BY 1",
)
R.add(
    "k_sentinels",
    lambda s, d: K.with_sentinels(table(s, d, "graph_entities"), {"docstring": "", "community_id": "", "pagerank": 0.0}).select("id", "docstring", "community_id").distinct(),
    "SELECT DISTINCT id, coalesce(docstring, '') AS docstring, coalesce(community_id, '') AS community_id FROM graph_entities",
)
_LANG = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"
_FILES = f"f AS (SELECT project_id || '/' || file_path AS path, string_agg(content, chr(10) ORDER BY chunk_index, id) AS text, any_value({_LANG}) AS x FROM now GROUP BY project_id, file_path)"
R.add(
    "s_imports",
    lambda s, d: S.imported_names(sources(s, d)),
    f"""WITH {NOW}, {_FILES},
pf AS (SELECT path, unnest(regexp_extract_all(text, '(?m)^[ \\t]*from[ \\t]+([\\w.]+)[ \\t]+import[ \\t]+(\\([^)]*\\)|[^\\n;#]+)')) AS s FROM f WHERE x = 'py'),
pi AS (SELECT path, unnest(regexp_extract_all(text, '(?m)^[ \\t]*import[ \\t]+([^\\n;#]+)', 1)) AS s FROM f WHERE x = 'py'),
j AS (SELECT path, CASE x WHEN 'js' THEN 'javascript' ELSE 'typescript' END AS kind, unnest(regexp_extract_all(text, '(?m)^[ \\t]*import\\s+([^;''"]*?)\\s*from\\s+[''"]([^''"]+)[''"]')) AS s FROM f WHERE x IN ('js', 'ts')),
java AS (SELECT path, unnest(regexp_extract_all(text, '(?m)^[ \\t]*import\\s+(?:static\\s+)?([\\w.]+)', 1)) AS s FROM f WHERE x = 'java'),
go AS (SELECT path, unnest(regexp_extract_all(text, '(?m)^[ \\t]*import\\s+(?:[\\w.]+\\s+)?"([^"]+)"', 1)) AS s FROM f WHERE x = 'go'
  UNION ALL SELECT path, unnest(regexp_extract_all(b, '"([^"]+)"', 1)) FROM (SELECT path, unnest(regexp_extract_all(text, '(?m)^[ \\t]*import\\s*\\(([^)]*)\\)', 1)) AS b FROM f WHERE x = 'go')),
m AS (SELECT path, 'python' AS kind, regexp_extract(s, 'from[ \\t]+([\\w.]+)', 1) AS name FROM pf
  UNION ALL SELECT path, 'python', unnest(regexp_extract_all(regexp_replace(regexp_extract(s, '(?s)[ \\t]import[ \\t]+(.*)', 1), '#[^\\n]*', '', 'g'), '(\\w+)(?:\\s+as\\s+\\w+)?', 1)) FROM pf
  UNION ALL SELECT path, 'python', unnest(regexp_extract_all(s, '([\\w.]+)(?:\\s+as\\s+\\w+)?', 1)) FROM pi
  UNION ALL SELECT path, kind, regexp_extract(s, 'from\\s+[''"]([^''"]+)[''"]$', 1) FROM j
  UNION ALL SELECT path, kind, unnest(regexp_extract_all(regexp_extract(s, '\\{{([^}}]*)\\}}', 1), '(\\w+)(?:\\s+as\\s+\\w+)?', 1)) FROM j
  UNION ALL SELECT path, kind, regexp_extract(s, '^[ \\t]*import\\s+(\\w+)\\s+from', 1) FROM j
  UNION ALL SELECT path, 'java', unnest([s, string_split(s, '.')[-1]]) FROM java UNION ALL SELECT path, 'go', unnest([s, string_split(s, '/')[-1]]) FROM go)
SELECT DISTINCT * FROM m WHERE name <> ''""",
)


def _declared(spark: SparkSession, folder: str, python: str, java: str, javascript: str, typescript: str) -> DataFrame:
    """A small file for each function of the graph that declares something of its name, in the language of its path."""
    rows = table(spark, folder, "graph_entities").filter("file_path <> '' and name <> '' and lower(type) like '%function'").select("file_path", "name").distinct()
    language = T.language(F.col("file_path"))
    forms = {"python": python, "java": java, "javascript": javascript, "typescript": typescript}
    text = T.first_case([(language == k, F.regexp_replace(F.lit(form), "NAME", F.col("name"))) for k, form in forms.items()], None)
    return rows.select(F.concat_ws("#", "file_path", "name").alias("path"), text.alias("text"), language.alias("language")).filter("text is not null")


_DECLARED = f"d AS (SELECT DISTINCT file_path || '#' || name AS path, name, {_LANG} AS x FROM graph_entities WHERE file_path <> '' AND name <> '' AND lower(type) LIKE '%function')"
R.add(
    "s_routes",
    lambda s, d: S.routes(_declared(s, d, '@router.post("/items/NAME")\nasync def NAME(): ...', '@GetMapping("NAME")\npublic String NAME() {}', "app.delete('/api//NAME', NAME)", "@Put('NAME')\nNAME() {}")),
    f"""WITH {_DECLARED}
SELECT path, CASE x WHEN 'py' THEN 'fastapi' WHEN 'java' THEN 'spring' WHEN 'js' THEN 'express' ELSE 'nest' END AS kind, CASE x WHEN 'py' THEN 'post' WHEN 'java' THEN 'get' WHEN 'js' THEN 'delete' ELSE 'put' END AS method,
  CASE x WHEN 'py' THEN '/items/' WHEN 'js' THEN '/api/' ELSE '/' END || name AS route FROM d WHERE x IN ('py', 'java', 'js', 'ts')""",
)
R.add(
    "s_class_bases",
    lambda s, d: S.class_bases(_declared(s, d, "class NAME(Base[int], mixins.Loud, metaclass=Meta):", "class NAME<T> extends Base<T> implements A, B {", "class NAME extends Base {", "class NAME implements A, B {")),
    f"""WITH {_DECLARED}, b AS (SELECT path, name, CASE x WHEN 'py' THEN 'python' ELSE 'extends' END AS kind, unnest(CASE x WHEN 'py' THEN ['Base', 'mixins.Loud'] WHEN 'java' THEN ['Base', 'A', 'B'] WHEN 'js' THEN ['Base'] WHEN 'ts' THEN ['A', 'B'] END) AS base FROM d)
SELECT path, kind, name, base FROM b""",
)
_IGNORE = ["node_modules/", "/dist/", "*.min.js", "docs/**/readme*"]
R.add(
    "s_ignored",
    lambda s, d: states(s, d).select("file_path", S.ignored(F.col("file_path"), _IGNORE).alias("ignored")).distinct(),
    "SELECT DISTINCT file_path, regexp_matches(file_path, '(?:^|/)node_modules/') OR regexp_matches(file_path, '^dist/') OR regexp_matches(file_path, '(?:^|/)[^/]*\\.min\\.js(?:/|$)') OR regexp_matches(file_path, '^docs/(?:.*/)?readme[^/]*(?:/|$)') AS ignored FROM file_states",
)


def s_technology(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_entities").select("name", S.technology(F.col("name"), F.col("domain")).alias("technology")).distinct()


R.add("s_technology", s_technology, """SELECT DISTINCT name, CASE WHEN regexp_matches(t, 'postgres|mysql|mongo') THEN 'database' WHEN regexp_matches(t, 'redis|memcached') THEN 'cache'
  WHEN regexp_matches(t, 'kafka|rabbitmq') THEN 'queue' WHEN contains(t, 'nginx') THEN 'proxy' WHEN contains(t, 'elasticsearch') THEN 'search' ELSE 'service' END AS technology
FROM (SELECT name, lower(concat_ws(' ', name, domain)) AS t FROM graph_entities)""")  # fmt: skip


def g_entities_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One entity for each file, each named chunk without symbols and each symbol: type, project_id, file_path, name."""
    rows = chunks(spark, folder, "project_id", "file_path", "element_type", "element_name", "symbols")
    parts = [
        rows.select(F.lit("file").alias("type"), "project_id", "file_path", F.col("file_path").alias("name")),
        rows.filter((F.size("symbols") == 0) & (F.col("element_name") != "")).select(F.col("element_type").alias("type"), "project_id", "file_path", F.col("element_name").alias("name")),
        rows.select(F.lit("symbol").alias("type"), "project_id", "file_path", F.explode("symbols").alias("name")),
    ]
    return G.union_all(parts).distinct()


R.add(
    "g_entities_of_chunks",
    g_entities_of_chunks,
    f"""WITH {NOW} SELECT 'file' AS type, project_id, file_path, file_path AS name FROM now
UNION SELECT element_type, project_id, file_path, element_name FROM now WHERE len(symbols) = 0 AND element_name <> ''
UNION SELECT 'symbol', project_id, file_path, unnest(symbols) FROM now""",
)
R.add(
    "s_metadata",
    lambda s, d: chunks(s, d, "metadata").select("id", F.get_json_object("metadata.data", "$.size").try_cast("bigint").alias("size")),
    f"WITH {NOW} SELECT id, CASE WHEN json_valid(metadata.data) THEN try_cast(json_extract_string(metadata.data, '$.size') AS BIGINT) END AS size FROM now",
)

QUERIES, ORACLES = R.queries, R.oracles
