"""Aggregate, text and name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import chunking as C
from lodestrand.functions import text as T
from lodestrand.operators import aggregates as A
from lodestrand.plans.registry import Registry
from lodestrand.plans.search_queries import NOW, chunks
from lodestrand.sources.tables import table

R = Registry()


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def ents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_entities")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_RECALL_STOP = ", ".join(f"'{w}'" for w in T.RECALL_STOP_WORDS)


def kw(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[a-z]+$') AND w NOT IN ({_STOP}))"


R.add("a_count", lambda s, d: docs(s, d).filter("lang = 'de'").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM documents WHERE lang = 'de'")
R.add("a_types", lambda s, d: A.types_count(table(s, d, "graph_relationships")), "SELECT lower(trim(type)) AS type, count(*) AS n FROM graph_relationships GROUP BY 1")
R.add(
    "a_projects",
    lambda s, d: A.project_statistics(table(s, d, "document_chunks")).select("project_id", "chunks", "files", "languages", F.unix_micros("newest").alias("newest")),
    "SELECT project_id, count(*) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT nullif(trim(language), '')) AS languages, epoch_us(max(try_cast(indexed_at AS TIMESTAMPTZ))) AS newest FROM document_chunks GROUP BY 1",
)
_FOLDER = "coalesce(nullif(regexp_replace(file_path, '/?[^/]*$', ''), ''), '.')"
_FACETS = {
    "content_type": "lower(content_type)",
    "language": "coalesce(nullif(lower(trim(language)), ''), lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)))",
    "folder": _FOLDER,
    "term": f"unnest(list_distinct({kw('content')}))",
}
R.add(
    "a_facets",
    lambda s, d: A.facets(chunks(s, d, "content_type", "language", "file_path", "content")),
    f"WITH {NOW} " + " UNION ALL ".join(f"(SELECT '{k}' AS facet, value, count(*) AS n FROM (SELECT {v} AS value FROM now) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 10)" for k, v in _FACETS.items()),
)
R.add(
    "a_keywords",
    lambda s, d: A.top_keywords(docs(s, d), 40, text="text", source="source"),
    f"SELECT keyword, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, unnest({kw('text')}) AS keyword FROM documents) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 40",
)
_ACT = "act AS (SELECT project_id, file_path, count(*) AS chunks, min(moment) AS first, max(moment) AS last FROM (SELECT project_id, file_path, try_cast(source_modified_at AS TIMESTAMPTZ) AS moment FROM document_chunks) WHERE moment IS NOT NULL {and_} GROUP BY 1, 2)"
R.add(
    "a_file_activity",
    lambda s, d: A.file_activity(table(s, d, "document_chunks")).select("project_id", "file_path", "chunks", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last")),
    f"WITH {_ACT.format(and_='')} SELECT project_id, file_path, chunks, epoch_us(first) AS first, epoch_us(last) AS last FROM act",
)
R.add(
    "a_hot_folders",
    lambda s, d: A.hot_folders(table(s, d, "document_chunks"), F.lit("2024-06-01").cast("timestamp")).select("folder", "files", F.unix_micros("last").alias("last")),
    f"WITH {_ACT.format(and_=chr(65) + 'ND moment >= TIMESTAMPTZ ' + chr(39) + '2024-06-01 00:00:00+00' + chr(39))} SELECT {_FOLDER} AS folder, count(*) AS files, epoch_us(max(last)) AS last FROM act GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
R.add(
    "a_stale_folders",
    lambda s, d: A.stale_folders(table(s, d, "document_chunks"), F.lit("2025-06-01").cast("timestamp")).select("folder", "days"),
    f"WITH {_ACT.format(and_='')}, f AS (SELECT {_FOLDER} AS folder, max(last) AS newest FROM act GROUP BY 1) SELECT folder, CAST(date_diff('day', CAST(newest AS DATE), DATE '2025-06-01') AS INTEGER) AS days FROM f WHERE date_diff('day', CAST(newest AS DATE), DATE '2025-06-01') > 30",
)
_SPACED = "regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_WORDS = "list_filter(regexp_split_to_array(lower(" + _SPACED + "), '[\\s_.\\-]+'), lambda w: w <> '')"
R.add(
    "a_naming",
    lambda s, d: A.naming_patterns(ents(s, d)),
    f"""WITH w AS (SELECT DISTINCT id, regexp_replace(lower(trim(type)), '^code_', '') AS type, {_WORDS.format(c='name')} AS w FROM graph_entities),
e AS (SELECT id, type, 'first' AS side, w[1] AS word FROM w WHERE len(w) > 1 UNION ALL SELECT id, type, 'last', w[-1] FROM w WHERE len(w) > 1)
SELECT type, side, word, count(*) AS names FROM e GROUP BY ALL HAVING count(*) >= 3""",
)
R.add(
    "j_symbols_in_place",
    lambda s, d: A.symbols_in_place(ents(s, d), chunks(s, d, "doc_id", "line_start", "content")),
    f"""WITH {NOW}, l AS (SELECT doc_id, line_start, string_split(content, chr(10)) AS l FROM now WHERE line_start > 0),
x AS (SELECT doc_id, line_start + generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM l),
e AS (SELECT DISTINCT id, doc_id, name, line_start AS wanted FROM graph_entities WHERE doc_id <> '' AND line_start > 0)
SELECT id, bool_or(hit) AS valid FROM (SELECT e.id, EXISTS (SELECT 1 FROM x WHERE x.doc_id = e.doc_id AND x.n BETWEEN e.wanted - 3 AND e.wanted + 3 AND contains(x.line, e.name)) AS hit FROM e) GROUP BY id""",
)
R.add(
    "j_missing_symbols",
    lambda s, d: A.missing_symbols(chunks(s, d, "doc_id", "element_type", "element_name"), ents(s, d)),
    f"WITH {NOW} SELECT DISTINCT doc_id, element_name FROM now WHERE element_type = 'function' AND element_name <> '' AND NOT EXISTS (SELECT 1 FROM graph_entities g WHERE g.doc_id = now.doc_id AND g.name = now.element_name)",
)
R.add(
    "a_accuracy",
    lambda s, d: A.accuracy(A.symbols_in_place(ents(s, d), chunks(s, d, "doc_id", "line_start", "content")).withColumn("check", F.lit("symbols"))).select("check", "valid", "total", F.round("ratio", 6).alias("ratio"), "passed"),
)
R.add(
    "a_imports_together",
    lambda s, d: A.imports_together(table(s, d, "graph_relationships").select("source_id", "target_id", F.lower(F.trim("type")).alias("type"))),
    """WITH i AS (SELECT DISTINCT source_id, target_id FROM graph_relationships WHERE lower(trim(type)) = 'imports')
SELECT a.target_id, b.target_id AS other_id, count(*) AS n FROM i a JOIN i b ON a.source_id = b.source_id AND a.target_id < b.target_id GROUP BY ALL HAVING count(*) >= 2""",
)
R.add(
    "a_tokens",
    lambda s, d: A.token_statistics(docs(s, d), T.token_estimate(F.coalesce("text", F.lit("")))),
    "WITH t AS (SELECT CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS t FROM documents) SELECT CAST(sum(t) AS BIGINT) AS total, CAST(floor(avg(t)) AS BIGINT) AS mean, min(t) AS least, max(t) AS most FROM t",
)

# --------------------------------------------------------------------------- scalars
R.add("x_keywords", lambda s, d: docs(s, d).filter("text is not null").select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("words")), f"SELECT doc_id, array_to_string({kw('text')}, ' ') AS words FROM documents WHERE text IS NOT NULL")
R.add(
    "x_top_keywords",
    lambda s, d: docs(s, d).filter("text is not null").select("doc_id", F.array_join(T.top_keywords(F.col("text"), 5), " ").alias("words")),
    f"""WITH w AS (SELECT doc_id, unnest({kw('text')}) AS w FROM documents), g AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) <= 5),
l AS (SELECT doc_id, string_agg(w, ' ' ORDER BY n DESC, w) AS words FROM c GROUP BY doc_id) SELECT d.doc_id, coalesce(words, '') AS words FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id WHERE text IS NOT NULL""",
)
R.add(
    "u_keyword_similarity",
    lambda s, d: docs(s, d).filter("text is not null").select("doc_id", F.round(T.keyword_similarity(F.array_distinct(T.keywords(F.col("text"))), F.array(F.lit("session"), F.lit("record"), F.lit("shard"))), 6).alias("score")),
    f"""WITH k AS (SELECT doc_id, list_distinct({kw('text')}) AS k FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(k) AS n, len(list_intersect(k, ['session', 'record', 'shard'])) AS b FROM k) SELECT doc_id, round(b / (n + 3 - b), 6) AS score FROM c""",
)
R.add("x_words_of_name", lambda s, d: ents(s, d).select("id", F.array_join(T.words_of_name(F.col("name")), " ").alias("words")).distinct(), f"SELECT DISTINCT id, array_to_string({_WORDS.format(c='name')}, ' ') AS words FROM graph_entities")
R.add(
    "x_snake",
    lambda s, d: ents(s, d).select("name", T.snake(F.col("name")).alias("snake"), T.camel_expanded(F.col("name")).alias("spaced")).distinct(),
    f"""SELECT DISTINCT name, regexp_replace(regexp_replace(lower(replace(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '-', '_')), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS snake,
  {_SPACED.format(c='name')} AS spaced FROM graph_entities""",
)
R.add(
    "x_external_name",
    lambda s, d: ents(s, d).select("id", T.external_name(F.col("id")).alias("name")).distinct(),
    """WITH p AS (SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS p FROM graph_entities)
SELECT id, CASE WHEN length(p) > 100 THEN substring(p, 1, 50) || '_' || substring(md5(id), 1, 16) WHEN p = '' THEN 'unnamed' ELSE p END AS name FROM p""",
)
R.add(
    "x_paths",
    lambda s, d: table(s, d, "file_states").select("file_path", T.module_path(F.col("file_path")).alias("module"), T.extension(F.col("file_path")).alias("suffix"), T.folder(F.col("file_path")).alias("folder"), T.file_name(F.col("file_path")).alias("name"), T.file_priority(F.col("file_path")).alias("priority")).distinct(),
    f"""SELECT DISTINCT file_path, replace(regexp_replace(regexp_replace(regexp_replace(file_path, '\\.[A-Za-z0-9]+$', ''), '^(src|lib|app)/', ''), '/(__init__|index)$', ''), '/', '.') AS module,
  lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS suffix, {_FOLDER} AS folder, string_split(file_path, '/')[-1] AS name,
  CASE WHEN regexp_matches(lower(file_path), 'readme|doc|guide|tutorial') THEN 0 WHEN regexp_matches(lower(file_path), '\\.(py|js|ts|java|cpp|c|go|rs)$') THEN 1 WHEN regexp_matches(lower(file_path), '\\.(yaml|yml|json|toml|ini|conf)$') THEN 2 ELSE 3 END AS priority FROM file_states""",
)
R.add(
    "x_languages",
    lambda s, d: table(s, d, "file_states").select("file_path", T.language(F.col("file_path")).alias("language"), T.content_type(F.col("file_path")).alias("kind"), T.importance(F.col("file_path")).alias("importance")).distinct(),
    """WITH f AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS x, lower(file_path) AS l FROM file_states)
SELECT file_path, CASE x WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' END AS language,
  CASE WHEN x = 'md' THEN 'text/document' WHEN x IN ('py', 'js', 'ts', 'java', 'go', 'rs') THEN 'text/code' ELSE 'application/octet-stream' END AS kind,
  CASE WHEN regexp_matches(file_path, '(?i)(config|settings|\\.env|\\.yaml|\\.yml|\\.toml|\\.json|Makefile|Dockerfile|docker-compose)') THEN 'config' WHEN regexp_matches(file_path, '(?i)(main\\.|index\\.|app\\.|server\\.|__main__|manage\\.py|wsgi|asgi)') THEN 'entry_point'
    WHEN regexp_matches(file_path, '(?i)(test_|_test\\.|\\.test\\.|spec\\.|\\.spec\\.)') THEN 'test' END AS importance FROM f""",
)
R.add(
    "x_complexity",
    lambda s, d: chunks(s, d, "content").select("id", T.complexity(F.col("content")).alias("complexity")),
    f"WITH {NOW} SELECT id, CAST(least(10, 1 + {' + '.join(f'len(regexp_extract_all(content, {chr(39)}{p}{chr(39)}))' for p in ('if ', 'for ', 'while ', 'switch ', 'case '))}) AS INTEGER) AS complexity FROM now",
)
R.add(
    "x_query_tokens",
    lambda s, d: table(s, d, "eval_items").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"), T.token_overlap(F.col("text"), F.array(F.lit("edge"), F.lit("node"), F.lit("survive"))).alias("overlap")),
    f"""WITH w AS (SELECT item_id, text, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{{3,}}'), lambda x: lower(x)) AS w FROM eval_items), u AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
d AS (SELECT item_id, w, min(i) AS i FROM u WHERE w NOT IN ({_RECALL_STOP}) GROUP BY ALL), l AS (SELECT item_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM d GROUP BY item_id)
SELECT e.item_id, coalesce(tokens, '') AS tokens, CAST(contains(lower(text), 'edge') AS INTEGER) + CAST(contains(lower(text), 'node') AS INTEGER) + CAST(contains(lower(text), 'survive') AS INTEGER) AS overlap FROM eval_items e LEFT JOIN l ON l.item_id = e.item_id""",
)
R.add("x_fts_text", lambda s, d: docs(s, d).select("doc_id", T.fts_text(F.col("text")).alias("text")), "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM documents")
R.add("x_code_fts", lambda s, d: chunks(s, d, "symbols", "content").select("id", T.code_fts_text(F.col("symbols"), F.col("content")).alias("text")))
R.add("x_sanitized", lambda s, d: table(s, d, "eval_items").select("item_id", T.sanitized(F.col("text")).alias("query")),
      """SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[+\\-!(){}\\[\\]^"~*?:\\\\/&|]', ' ', 'g'), '\\bAND\\b', 'and', 'g'), '\\bOR\\b', 'or', 'g'), '\\bNOT\\b', 'not', 'g'), '\\s+', ' ', 'g')) AS query FROM eval_items""")  # fmt: skip
R.add(
    "x_typos",
    lambda s, d: table(s, d, "subject_areas").select("subject", F.explode(T.typo_variants(F.col("subject"))).alias("variant")),
    """WITH p AS (SELECT subject, unnest(range(1, length(subject) + 1)) AS i FROM subject_areas),
v AS (SELECT subject, i AS o, substring(subject, 1, i - 1) || substring(subject, i + 1) AS v FROM p UNION ALL SELECT subject, 1000 + i, substring(subject, 1, i - 1) || substring(subject, i + 1, 1) || substring(subject, i, 1) || substring(subject, i + 2) FROM p WHERE i < length(subject)),
d AS (SELECT subject, v, min(o) AS o FROM v WHERE v <> subject AND v <> '' GROUP BY ALL)
SELECT subject, v AS variant FROM d QUALIFY row_number() OVER (PARTITION BY subject ORDER BY o) <= 10""",
)
R.add("x_name_from_id", lambda s, d: ents(s, d).select("id", T.name_from_id(F.col("id")).alias("name")).distinct(), "SELECT DISTINCT id, CASE WHEN len(string_split(id, '::')) >= 4 THEN string_split(id, '::')[-1] ELSE id END AS name FROM graph_entities")
R.add("x_project_id", lambda s, d: docs(s, d).select("source", T.project_id(F.col("source")).alias("project")).distinct(), "SELECT DISTINCT source, CASE WHEN regexp_matches(source, '^[A-Za-z0-9_-]{1,64}$') THEN lower(source) END AS project FROM documents")
R.add("x_overview_query", lambda s, d: table(s, d, "eval_items").select("item_id", T.overview_query(F.col("text")).alias("overview")),
      "SELECT item_id, regexp_matches(lower(text), '\\b(readme|overview|architecture|getting[.\\-_\\s]?started)\\b|\\b(what\\s+(does|is)|how\\s+(does|to|do)|purpose|intro(duction)?)\\b|\\b(documentation|docs|guide|tutorial|manual)\\b|\\b(project\\s+structure|codebase|explain|describe)\\b') AS overview FROM eval_items")
R.add("x_route_path", lambda s, d: ents(s, d).select("file_path", "name", T.route_path(F.col("file_path"), F.col("name")).alias("path")).distinct(),
      "WITH j AS (SELECT DISTINCT file_path, name, regexp_replace('/' || coalesce(file_path, '') || '/' || coalesce(name, ''), '/+', '/', 'g') AS j FROM graph_entities) SELECT file_path, name, CASE WHEN j = '/' THEN j ELSE regexp_replace(j, '/$', '') END AS path FROM j")
R.add("x_session_header", lambda s, d: docs(s, d).filter("text is not null").select("doc_id", T.session_header(F.col("text")).alias("header")),
      "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10))[1:2], lambda x: regexp_matches(x, '^(Session|Date):')), chr(10)) AS header FROM documents WHERE text IS NOT NULL")
R.add(
    "v_fuzzy",
    lambda s, d: ents(s, d).select("name", F.round(T.fuzzy_score("mergeSlotQuery", F.col("name")), 6).alias("score")).distinct(),
    """WITH e AS (SELECT DISTINCT name, lower(name) AS l, list_distinct(list_filter(regexp_split_to_array(lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '\\s+'), lambda w: length(w) > 1)) AS w FROM graph_entities),
c AS (SELECT *, len(list_intersect(w, ['merge', 'slot', 'query'])) AS n FROM e)
SELECT name, round(CASE WHEN l = 'mergeslotquery' THEN 1.0 WHEN contains(l, 'mergeslotquery') THEN 0.8 + 0.1 * 14 / length(l) WHEN contains('mergeslotquery', l) THEN 0.7 WHEN n > 0 THEN 0.5 + 0.4 * n / greatest(3, len(w))
  WHEN len(list_filter(w, lambda b: contains(b, 'merge') OR contains('merge', b) OR contains(b, 'slot') OR contains('slot', b) OR contains(b, 'query') OR contains('query', b))) > 0 THEN 0.4 ELSE 0.0 END, 6) AS score FROM c""",
)
R.add(
    "x_line_windows",
    lambda s, d: chunks(s, d, "content").select("id", F.explode(C.line_windows(F.col("content"), 20, 5)).alias("w")).select("id", "w.line_start", "w.line_end", "w.content"),
    f"""WITH {NOW}, l AS (SELECT id, string_split(content, chr(10)) AS l FROM now), s AS (SELECT id, l, unnest(range(1, greatest(1, len(l) - 5) + 1, 15)) AS s FROM l)
SELECT id, CAST(s AS INTEGER) AS line_start, CAST(least(len(l), s + 19) AS INTEGER) AS line_end, array_to_string(l[s:s + 19], chr(10)) AS content FROM s WHERE regexp_matches(array_to_string(l[s:s + 19], chr(10)), '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]')""",
)
_END = "length(regexp_extract(substring(text, pos + 156 + 1, 100), '(?s)^(?:.*?{})+'))"
_W = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]"
_ENDS = [_END.replace("{}", p) for p in ("\\n\\n", "\\." + _W + "+", "\\n", _W + "+")]
R.add(
    "x_token_windows",
    lambda s, d: docs(s, d).filter("text is not null").select("doc_id", F.explode(C.token_windows(F.col("text"), 64, 8)).alias("piece")).groupBy("doc_id", "piece").agg(F.count("*").alias("n")),
    f"""WITH RECURSIVE p AS (
  SELECT doc_id, text, 0 AS pos, false AS done, NULL::VARCHAR AS piece FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, CASE WHEN pos + 256 >= length(text) THEN length(text) + 1 ELSE greatest(pos + 1, stop - 32) END, pos + 256 >= length(text), substring(text, pos + 1, stop - pos)
  FROM (SELECT *, CASE WHEN pos + 256 >= length(text) THEN length(text) ELSE pos + 156 + CASE {' '.join(f'WHEN {e} > 0 THEN {e}' for e in _ENDS)} ELSE 100 END END AS stop FROM p WHERE NOT done AND pos < length(text)))
SELECT doc_id, piece, count(*) AS n FROM p WHERE piece IS NOT NULL AND regexp_matches(piece, '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]') GROUP BY ALL""",
)
R.add("w_packed", lambda s, d: docs(s, d).filter("text is not null").select("doc_id", F.posexplode(C.merged_small(C.paragraphs(F.col("text"), 400), 80)).alias("n", "piece")))
R.add(
    "x_hashed_vector",
    lambda s, d: table(s, d, "subject_areas").select("subject", F.posexplode(C.hashed_vector(F.col("description"))).alias("cell", "value")).select("subject", "cell", F.round("value", 6).alias("value")),
    """WITH g AS (SELECT subject, sha256(substring(description, CAST(i AS INTEGER), 3)) AS h FROM (SELECT subject, description, unnest(range(1, length(description) - 1)) AS i FROM subject_areas)),
v AS (SELECT subject, ('0x' || h[1:8])::BIGINT % 128 AS cell, sum((('0x' || h[9:10])::BIGINT - 128) / 128) AS v FROM g GROUP BY ALL),
n AS (SELECT subject, sqrt(sum(v * v)) AS n FROM v GROUP BY subject)
SELECT s.subject, CAST(c.cell AS INTEGER) AS cell, round(coalesce(v / nullif(n, 0), 0), 6) AS value FROM subject_areas s CROSS JOIN (SELECT unnest(range(128)) AS cell) c LEFT JOIN v ON v.subject = s.subject AND v.cell = c.cell LEFT JOIN n ON n.subject = s.subject""",
)

QUERIES, ORACLES = R.queries, R.oracles
