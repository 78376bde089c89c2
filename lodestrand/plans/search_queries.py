"""Search, filter and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import search as S
from lodestrand.operators.filters import all_of, any_of, escaped_like, from_dict, list_entities, path_matches, query, where
from lodestrand.plans.registry import Registry
from lodestrand.plans.scratch import Scratch
from lodestrand.sources.tables import current_rows, table

R = Registry()

NOW = """now AS (
  SELECT * FROM document_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1
)"""
WORDS = "stale shard retention policy"


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, folder, "document_chunks").select("id", "indexed_at", *columns)).drop("indexed_at")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors that are searched for: every embedding whose id is divisible by 50."""
    return table(spark, folder, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.wanted::DOUBLE[]), 9)"
_Q = "q AS (SELECT vec_id AS query_id, embedding AS wanted FROM embeddings WHERE vec_id % 50 = 0)"


def _vector(mode: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = S.vector_search_all(_vectors(spark, folder), questions(spark, folder), 20, mode=mode)
        return found.select("query_id", F.col("id").alias("vec_id"), "label", F.round("score", 6).alias("score"))

    return run


for _mode, _sql in (("clamp", f"greatest(0, least(1, {_COS}))"), ("half", f"({_COS} + 1) / 2"), ("inverse", f"1 / (2 - {_COS})")):
    R.add(f"v_vector_{_mode}", _vector(_mode), f"WITH {_Q} SELECT query_id, vec_id, label, round({_sql}, 6) AS score FROM embeddings e, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, vec_id) <= 20")


def v_fraction(spark: SparkSession, folder: str) -> DataFrame:
    found = S.fraction_search(chunks(spark, folder, "content", "file_path"), WORDS, 50)
    return found.select("id", "file_path", F.round("score", 6).alias("score"))


_FRACTION = "(" + " + ".join(f"CAST(contains(lower(content), '{w}') AS INTEGER)" for w in WORDS.split()) + f") / {len(WORDS.split())}"
R.add("v_fraction", v_fraction, f"WITH {NOW} SELECT id, file_path, round({_FRACTION}, 6) AS score FROM now WHERE {_FRACTION} >= 0.01 ORDER BY {_FRACTION} DESC, id LIMIT 50")


def v_bm25(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.bm25_search(rows, "patient diagnosis schema", 50, text="text").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


R.add(
    "v_bm25",
    v_bm25,
    """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\w]+') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'patient')) AS t0, len(list_filter(w, lambda x: x = 'diagnosis')) AS t1,
  len(list_filter(w, lambda x: x = 'schema')) AS t2 FROM d),
s AS (SELECT count(*) AS r, avg(n) AS m, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM n),
x AS (SELECT doc_id,
  ln(1 + (r - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (r - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / m))
  + ln(1 + (r - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / m)) AS score FROM n, s WHERE t0 > 0 OR t1 > 0 OR t2 > 0)
SELECT doc_id, round(score, 6) AS score FROM x ORDER BY x.score DESC, doc_id LIMIT 50""",
)


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """For each vector that is searched for: the most similar vectors, and the texts that a text search finds."""
    wanted = questions(spark, folder)
    found = S.vector_search_all(_vectors(spark, folder).drop("label"), wanted, 30).select("query_id", "id", "score")
    docs = table(spark, folder, "documents").select((F.col("doc_id") - 1000000).alias("id"), F.col("text").alias("content"))
    return found, S.fraction_search(docs, WORDS, 30).select("id", "score").crossJoin(wanted.select("query_id"))  # 30 rows for each query


_TOLD = _FRACTION.replace("content", "text")
_LISTS = f"""{_Q},
v AS (SELECT query_id, vec_id AS id, greatest(0, least(1, {_COS})) AS score FROM embeddings e, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, vec_id) <= 30),
one AS (SELECT doc_id - 1000000 AS id, {_TOLD} AS score FROM documents WHERE {_TOLD} >= 0.01 ORDER BY score DESC, id LIMIT 30),
t AS (SELECT query_id, id, score FROM one, q)"""
R.add(
    "v_rrf",
    lambda s, d: S.fuse_by_rank(*_lists(s, d), keys=["query_id"]).select("query_id", "id", F.round("score", 6).alias("score")),
    f"""WITH {_LISTS},
p AS (SELECT query_id, id, 0.7 * greatest(0.1, score) / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) AS part FROM v
  UNION ALL SELECT query_id, id, 0.3 * greatest(0.1, score) / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) FROM t),
f AS (SELECT query_id, id, sum(part) * CASE WHEN count(*) > 1 THEN 1.3 ELSE 1 END AS score FROM p GROUP BY ALL)
SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM f""",
)
R.add(
    "v_linear",
    lambda s, d: S.fuse_by_weight(*_lists(s, d), keys=["query_id"]).select("query_id", "id", F.round("score", 6).alias("score")),
    f"""WITH {_LISTS},
f AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, 0.7 * coalesce(v.score, 0) + 0.3 * coalesce(t.score, 0) AS score FROM v FULL JOIN t ON v.id = t.id AND v.query_id = t.query_id)
SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM f""",
)


def _chunk_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = chunks(spark, folder, "content", "element_name")
    return S.fraction_search(rows, "merge slot query", 60).select("id", "score"), S.fraction_search(rows, WORDS, 60).select("id", "score")


_TWO = f"""{NOW}, v AS (SELECT id, (CAST(contains(lower(content), 'merge') AS INTEGER) + CAST(contains(lower(content), 'slot') AS INTEGER) + CAST(contains(lower(content), 'query') AS INTEGER)) / 3 AS score FROM now QUALIFY score >= 0.01 AND row_number() OVER (ORDER BY score DESC, id) <= 60),
t AS (SELECT id, {_FRACTION} AS score FROM now QUALIFY score >= 0.01 AND row_number() OVER (ORDER BY score DESC, id) <= 60)"""
R.add(
    "v_merge_first",
    lambda s, d: S.merge_first(*_chunk_lists(s, d), 40).select("id", F.round("score", 6).alias("score"), "source"),
    f"""WITH {_TWO}, m AS (SELECT id, 0.7 * score AS score, 'vector' AS source FROM v UNION ALL SELECT id, 0.3 * score, 'text' FROM t WHERE id NOT IN (SELECT id FROM v))
SELECT id, round(score, 6) AS score, source FROM m ORDER BY m.score DESC, id LIMIT 40""",
)
R.add("u_in_both", lambda s, d: S.in_both(*_chunk_lists(s, d)), f"WITH {_TWO} SELECT id FROM v INTERSECT SELECT id FROM t")


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return S.fraction_search(chunks(spark, folder, "content", "file_path", "content_type", "element_name"), WORDS, 60)


_RESULTS = f"{NOW}, found AS (SELECT id, content, file_path, content_type, element_name, {_FRACTION} AS score FROM now WHERE {_FRACTION} >= 0.01 ORDER BY score DESC, id LIMIT 60)"
R.add("v_best_of_file", lambda s, d: S.best_of_file(_results(s, d), 1).select("id", "file_path"), f"WITH {_RESULTS} SELECT id, file_path FROM found QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) = 1")
R.add(
    "v_overview",
    lambda s, d: S.boost_overview(_results(s, d)).select("id", F.round("score", 6).alias("score")),
    f"WITH {_RESULTS} SELECT id, round(CASE WHEN regexp_matches(lower(file_path), 'readme|index|main|overview|introduction') THEN least(1, score * 1.5) ELSE score END, 6) AS score FROM found",
)
R.add("v_prefer_type", lambda s, d: S.boost_type(_results(s, d), "CODE").select("id", F.round("score", 6).alias("score")), f"WITH {_RESULTS} SELECT id, round(CASE WHEN lower(content_type) = 'code' THEN least(1, score * 1.2) ELSE score END, 6) AS score FROM found")
R.add("v_by_range", lambda s, d: S.by_range(_results(s, d)).select("id", F.round("score", 6).alias("score")), f"WITH {_RESULTS} SELECT id, round(CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 6) AS score FROM found")
_PRIORITY = """CASE WHEN regexp_matches(lower(file_path), 'readme|doc|guide|tutorial') THEN 0 WHEN regexp_matches(lower(file_path), '\\.(py|js|ts|java|cpp|c|go|rs)$') THEN 1
  WHEN regexp_matches(lower(file_path), '\\.(yaml|yml|json|toml|ini|conf)$') THEN 2 ELSE 3 END"""
R.add(
    "v_second_order",
    lambda s, d: S.second_order(_results(s, d)).select("id", "position"),
    f"""WITH {_RESULTS},
g AS (SELECT *, CASE WHEN lag(score) OVER (ORDER BY score DESC, id) - score > 0.01 THEN 1 ELSE 0 END AS fresh FROM found),
h AS (SELECT *, sum(fresh) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT id, CAST(row_number() OVER (ORDER BY grp, {_PRIORITY}, score DESC, id) AS INTEGER) AS position FROM h""",
)
R.add(
    "v_round_robin",
    lambda s, d: S.round_robin(_results(s, d), 40).select("id", "position"),
    f"""WITH {_RESULTS},
r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS n, max(score) OVER (PARTITION BY file_path) AS best FROM found),
k AS (SELECT * FROM r WHERE n <= 2 ORDER BY n, best DESC, file_path, id LIMIT 40)
SELECT id, CAST(row_number() OVER (ORDER BY n, best DESC, file_path, id) AS INTEGER) AS position FROM k""",
)
R.add("v_diversity", lambda s, d: S.diversity(_results(s, d)).select(F.round("diversity", 6).alias("diversity")), f"WITH {_RESULTS} SELECT round(count(DISTINCT file_path) / count(*), 6) AS diversity FROM found")
R.add("v_confidence", lambda s, d: _results(s, d).select("id", S.confidence(F.col("score")).alias("confidence")), f"WITH {_RESULTS} SELECT id, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM found")
R.add(
    "v_ambiguity",
    lambda s, d: S.ambiguity(_results(s, d)),
    f"""WITH {_RESULTS}, top AS (SELECT max(score) AS top FROM found),
c AS (SELECT max(top) AS top, count(*) AS n, count(DISTINCT nullif(file_path, '')) AS files, count(DISTINCT nullif(element_name, '')) AS names FROM found, top WHERE top - score <= 0.1),
r AS (SELECT n, CASE WHEN top IS NULL THEN 'no_results' WHEN top < 0.4 THEN 'low_confidence' WHEN n > 1 AND (files > 1 OR names > 1) THEN 'multiple_matches' END AS reason FROM c)
SELECT reason IS NOT NULL AS ambiguous, reason, CASE WHEN reason = 'multiple_matches' THEN n ELSE 0 END AS matches FROM r""",
)


def v_content_boost(spark: SparkSession, folder: str) -> DataFrame:
    return S.boost_content(_results(spark, folder), "staleShard policy").select("id", F.round("score", 6).alias("score"))


_HITS = ", ".join(f"CAST(contains(lower(coalesce(content, '') || ' ' || coalesce(file_path, '')), '{w}') AS INTEGER) AS h{i}" for i, w in enumerate(("stale", "shard", "policy")))
R.add(
    "v_content_boost",
    v_content_boost,
    f"""WITH {_RESULTS}, h AS (SELECT id, score, {_HITS} FROM found),
w AS (SELECT *, max(score) OVER () AS top, {', '.join(f'1 / greatest(0.05, avg(h{i}) OVER ()) AS w{i}' for i in range(3))} FROM h),
s AS (SELECT *, (h0 * w0 + h1 * w1 + h2 * w2) / (w0 + w1 + w2) AS share FROM w),
g AS (SELECT id, CASE WHEN share >= 0.5 THEN greatest(score, top) ELSE score END * (1 + 0.5 * share) AS raised FROM s)
SELECT id, round(raised / max(raised) OVER (), 6) AS score FROM g""",
)


def v_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline over current chunks, for the vector of every embedding whose id is divisible by 50."""
    # read three times by the pipeline, so picked once
    rows = Scratch(spark).write(chunks(spark, folder, "content", "file_path", "vector"), "current")
    found = S.hybrid_search(rows, WORDS, questions(spark, folder), 20, overview=True)
    return found.select("query_id", "id", "file_path", F.round("score", 6).alias("score"), "position")


R.add("v_hybrid", v_hybrid)


def v_scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    return S.scan_lines(chunks(spark, folder, "content", "file_path"), "may outlive its").select("id", "file_path", "line_number", "line", "score")


R.add(
    "s_scan_lines",
    v_scan_lines,
    f"""WITH {NOW}, l AS (SELECT id, file_path, string_split(content, chr(10)) AS l FROM now WHERE contains(lower(content), 'may outlive its')),
x AS (SELECT id, file_path, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_number FROM l)
SELECT id, file_path, line_number, line, CAST(1.0 AS DOUBLE) AS score FROM x WHERE contains(lower(line), 'may outlive its')""",
)
R.add(
    "v_blend_rank",
    lambda s, d: S.blend_rank(S.fraction_search(chunks(s, d, "content", "doc_id"), WORDS, 60), table(s, d, "graph_entities").select("doc_id", "pagerank"), 0.3).select("id", F.round("score", 6).alias("score")),
    f"""WITH {NOW}, found AS (SELECT id, doc_id, {_FRACTION} AS score FROM now WHERE {_FRACTION} >= 0.01 ORDER BY score DESC, id LIMIT 60),
r AS (SELECT doc_id, max(pagerank::DOUBLE) AS r FROM graph_entities GROUP BY doc_id)
SELECT id, round(0.7 * score + 0.3 * coalesce(r, 0), 6) AS score FROM found LEFT JOIN r ON r.doc_id = found.doc_id""",
)
R.add(
    "v_with_entities",
    lambda s, d: S.with_entities(S.fraction_search(chunks(s, d, "content", "doc_id"), WORDS, 60), table(s, d, "graph_entities")).select("id", "entities"),
    f"""WITH {NOW}, found AS (SELECT id, doc_id, {_FRACTION} AS score FROM now WHERE {_FRACTION} >= 0.01 ORDER BY score DESC, id LIMIT 60),
n AS (SELECT DISTINCT doc_id, name FROM graph_entities WHERE doc_id <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY name) <= 1000000),
m AS (SELECT doc_id, name FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY name) <= 20),
l AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS entities FROM m GROUP BY doc_id)
SELECT id, coalesce(entities, '') AS entities FROM found LEFT JOIN l ON l.doc_id = found.doc_id""",
)

# --------------------------------------------------------------------------- filters
_F = where("language", "IN", ["python", "go"]) & (where("chunk_index", ">=", 2) | where("content_type", "=", "PROSE")) & ~where("file_path", "LIKE", "src/%")
R.add(
    "f_tree",
    lambda s, d: table(s, d, "document_chunks").filter(_F.column()).select("id", "language", "chunk_index").distinct(),
    "SELECT DISTINCT id, language, chunk_index FROM document_chunks WHERE language IN ('python', 'go') AND (chunk_index >= 2 OR content_type = 'PROSE') AND NOT file_path LIKE 'src/%'",
)
_D = {"lang": ["en", "de"], "NOT": {"doc_kind": None}, "OR": [{"n_chars": (">", 2000)}, {"doc_kind": "issue"}]}
R.add(
    "f_dict",
    lambda s, d: table(s, d, "documents").filter(from_dict(_D).column()).select("doc_id", "lang", "doc_kind"),
    "SELECT doc_id, lang, doc_kind FROM documents WHERE lang IN ('en', 'de') AND NOT doc_kind IS NULL AND (n_chars > 2000 OR doc_kind = 'issue')",
)
R.add("f_three_valued", lambda s, d: table(s, d, "documents").filter((~where("n_chars", ">", 1000)).column()).select("doc_id"), "SELECT doc_id FROM documents WHERE NOT n_chars > 1000")
R.add("f_two_valued", lambda s, d: table(s, d, "documents").filter((~where("n_chars", ">", 1000)).column(two_valued=True)).select("doc_id"), "SELECT doc_id FROM documents WHERE NOT coalesce(n_chars > 1000, false)")
R.add("f_empty_in", lambda s, d: table(s, d, "documents").filter(any_of(where("lang", "IN", []), where("lang", "IS NULL")).column()).select("doc_id"), "SELECT doc_id FROM documents WHERE lang IS NULL")
R.add("f_like_escaped", lambda s, d: table(s, d, "graph_entities").filter(where("name", "ILIKE", "%" + escaped_like("_scope") + "%").column()).select("id").distinct(), "SELECT DISTINCT id FROM graph_entities WHERE contains(lower(name), '_scope')")
R.add(
    "f_page",
    lambda s, d: query(table(s, d, "documents").withColumnRenamed("doc_id", "id"), {"lang": "en"}, order=["-n_chars"], offset=20, limit=30, columns=["n_chars"]).withColumnRenamed("id", "doc_id"),
    "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 30 OFFSET 20",
)
R.add("f_projects", lambda s, d: query(table(s, d, "file_states"), projects=["ridgeweaver", "briarmill"]).select("project_id", "file_path").distinct(), "SELECT DISTINCT project_id, file_path FROM file_states WHERE project_id IN ('ridgeweaver', 'briarmill')")
R.add("f_path", lambda s, d: table(s, d, "graph_entities").filter(path_matches(F.col("file_path"), "src\\gen")).select("id").distinct(), "SELECT DISTINCT id FROM graph_entities WHERE file_path = 'src/gen' OR file_path LIKE '%/src/gen' OR contains(file_path, 'src/gen')")
R.add(
    "f_list_entities",
    lambda s, d: list_entities(table(s, d, "graph_entities"), kind="function", pattern="*merge*", limit=25, offset=5).select("id", "name", "total", "has_more"),
    """WITH e AS (SELECT id, min(name) AS name FROM graph_entities WHERE lower(trim(type)) = 'function' AND lower(name) LIKE '%merge%' GROUP BY id)
SELECT id, name, (SELECT count(*) FROM e) AS total, (SELECT count(*) FROM e) > 30 AS has_more FROM e ORDER BY name, id LIMIT 25 OFFSET 5""",
)
R.add(
    "f_by_helpers",
    lambda s, d: table(s, d, "graph_relationships").filter(all_of(where("type", "=", "calls"), None, where("metadata", "IS NOT NULL")).column()).select("id", "source_id", "target_id").distinct(),
    "SELECT DISTINCT id, source_id, target_id FROM graph_relationships WHERE type = 'calls' AND metadata IS NOT NULL",
)

QUERIES, ORACLES = R.queries, R.oracles
