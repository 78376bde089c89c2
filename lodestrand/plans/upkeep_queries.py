"""Queries of sessions, index states, memory upkeep and small functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import graph as G
from lodestrand.operators import memory as M
from lodestrand.operators import search as S
from lodestrand.operators import sessions as U
from lodestrand.plans.event_queries import IT, items
from lodestrand.plans.graph_queries import ents, rel
from lodestrand.plans.registry import Registry
from lodestrand.plans.search_queries import NOW, chunks
from lodestrand.sources import sinks as K
from lodestrand.sources.tables import table

R = Registry()


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Each user of the events as a session, in force until a purchase of theirs came last."""
    rows = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return rows.groupBy(F.col("user_id").alias("session_id")).agg(F.concat(F.lit("p"), F.col("user_id") % 7).alias("project_id"), F.max("ts").alias("last_active"), (last == "purchase").alias("is_expired"), last.alias("last_type"))


SE = """se AS (SELECT user_id AS session_id, 'p' || (user_id % 7) AS project_id, max(ts) AS last_active, arg_max(event_type, (ts, event_id)) = 'purchase' AS is_expired, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id)"""
R.add("t_sessions", lambda s, d: U.list_sessions(sessions(s, d), "p3", limit=20).select("session_id", F.unix_micros("last_active").alias("at")), f"WITH {SE} SELECT session_id, epoch_us(last_active) AS at FROM se WHERE project_id = 'p3' AND NOT is_expired ORDER BY last_active DESC, session_id LIMIT 20")
_LAST = "(SELECT max(ts) FROM events)"


def _ended(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    now = table(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return sessions(spark, folder).crossJoin(F.broadcast(now)), F.col("now")  # one row


R.add("r_expired_sessions", lambda s, d: U.expired_sessions(*_ended(s, d), 48.0).select("session_id", F.round("inactive_hours", 6).alias("hours")), f"WITH {SE}, h AS (SELECT *, (epoch_us({_LAST}) - epoch_us(last_active)) / 3.6e9 AS h FROM se) SELECT session_id, round(h, 6) AS hours FROM h WHERE NOT is_expired AND h > 48")
R.add("r_expire", lambda s, d: U.expire(*_ended(s, d), 48.0).groupBy("project_id", "is_expired").agg(F.count("*").alias("n")), f"WITH {SE} SELECT project_id, is_expired OR (epoch_us({_LAST}) - epoch_us(last_active)) / 3.6e9 > 48 AS is_expired, count(*) AS n FROM se GROUP BY ALL")


def r_index_state(spark: SparkSession, folder: str) -> DataFrame:
    """Projects by the files of the chunk table; open operations are the sessions whose last event isn't an end."""
    counts = chunks(spark, folder, "project_id").groupBy("project_id").agg(F.count("*").alias("chunks"))
    rows, now = _ended(spark, folder)
    status = F.when(F.col("last_type") == "signup", "started").when(F.col("last_type") == "click", "progress").otherwise("completed")
    operations = rows.select("project_id", status.alias("status"), F.col("last_active").alias("last_at"), "now")
    latest = operations.agg(F.max("now").alias("now"))
    both = U.index_state(operations.drop("now"), counts, F.lit(latest.first().now), 100, 600.0)  # one row
    return both


R.add(
    "r_index_state",
    r_index_state,
    f"""WITH {NOW}, {SE}, c AS (SELECT project_id, count(*) AS chunks FROM now GROUP BY 1), l AS (SELECT project_id, max(last_active) AS seen FROM se WHERE last_type IN ('signup', 'click') GROUP BY 1)
SELECT coalesce(c.project_id, l.project_id) AS project_id, CASE WHEN seen IS NOT NULL AND epoch_us({_LAST}) - epoch_us(seen) > 600000000 THEN 'STALE' WHEN seen IS NOT NULL THEN 'INDEXING' WHEN coalesce(chunks, 0) < 100 THEN 'SPARSE' ELSE 'READY' END AS state
FROM c FULL JOIN l ON c.project_id = l.project_id""",
)
R.add(
    "m_capacity",
    lambda s, d: M.within_capacity(items(s, d), 5, ["agent_id"], "created_at").select("agent_id", "id"),
    f"WITH {IT} SELECT agent_id, id FROM items QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id) <= 5",
)
R.add(
    "m_conversation",
    lambda s, d: M.conversation(items(s, d).withColumn("session_id", F.col("agent_id")), items(s, d).select(F.col("agent_id").alias("session_id")), 10).select("session_id", "id", "tier", "position"),
    f"""WITH {IT}, n AS (SELECT agent_id, id, created_at, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS n FROM items WHERE tier = 'episodic')
SELECT agent_id AS session_id, id, 'working' AS tier, CAST(row_number() OVER (PARTITION BY agent_id ORDER BY n DESC) AS INTEGER) AS position FROM n WHERE n <= 10""",
)
R.add("m_cleared", lambda s, d: M.cleared(items(s, d), "briarmill", "working").groupBy("agent_id", "tier").agg(F.count("*").alias("n")), f"WITH {IT} SELECT agent_id, tier, count(*) AS n FROM items WHERE NOT (agent_id = 'briarmill' AND tier = 'working') GROUP BY ALL")
R.add(
    "m_feedback",
    lambda s, d: M.feedback_counts(table(s, d, "subject_labels").select(F.lower(F.trim("subject")).alias("kind"))),
    "SELECT coalesce(lower(trim(subject)), 'general') AS kind, count(*) AS n FROM subject_labels GROUP BY 1",
)
R.add(
    "k_delete_file_links",
    lambda s, d: (lambda e: K.without_file_links(rel(s, d), e, *_file(e)).groupBy("project_id").agg(F.count("*").alias("n")))(ents(s, d)),
    """WITH f AS (SELECT file_path, project_id FROM graph_entities WHERE file_path <> '' GROUP BY ALL ORDER BY count(DISTINCT id) DESC, file_path, project_id LIMIT 1),
x AS (SELECT DISTINCT e.id FROM graph_entities e JOIN f ON e.file_path = f.file_path AND e.project_id = f.project_id)
SELECT r.project_id, count(*) AS n FROM graph_relationships r WHERE NOT (r.project_id = (SELECT project_id FROM f) AND (EXISTS (SELECT 1 FROM x WHERE x.id = r.source_id) OR EXISTS (SELECT 1 FROM x WHERE x.id = r.target_id))) GROUP BY 1""",
)


def _file(entities: DataFrame) -> tuple[str, str]:
    """The file with most entities, one row."""
    top = entities.filter("file_path <> ''").groupBy("file_path", "project_id").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "file_path", "project_id").first()
    return (top.file_path, top.project_id) if top else ("", "")


R.add("x_wildcards", lambda s, d: table(s, d, "eval_items").select("item_id", T.sanitized_with_wildcards(F.col("text")).alias("query")),
      """SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[+\\-!(){}\\[\\]^"~:\\\\/&|]', ' ', 'g'), '\\bAND\\b', 'and', 'g'), '\\bOR\\b', 'or', 'g'), '\\bNOT\\b', 'not', 'g'), '\\s+', ' ', 'g')) AS query FROM eval_items""")  # fmt: skip
R.add("x_truncated", lambda s, d: table(s, d, "documents").select("doc_id", T.truncated(F.col("text"), 100).alias("text")), "SELECT doc_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS text FROM documents")
R.add(
    "x_source_units",
    lambda s, d: ents(s, d).select("id", T.source_unit(F.lit("evidence"), F.col("file_path"), F.when(F.col("line_start") > 0, F.col("line_start")), F.when(F.col("line_end") > 0, F.col("line_end")), F.col("name")).alias("unit")).distinct(),
    """SELECT DISTINCT id, CASE WHEN file_path <> '' AND line_start > 0 THEN 'evidence:' || file_path || ':' || line_start || ':' || CASE WHEN line_end > 0 THEN line_end ELSE line_start END
  WHEN file_path <> '' THEN 'evidence:' || file_path || ':' || substring(sha256(trim(regexp_replace(lower(coalesce(name, '')), '\\s+', ' ', 'g'))), 1, 16) ELSE 'evidence:' || substring(sha256(trim(regexp_replace(lower(coalesce(name, '')), '\\s+', ' ', 'g'))), 1, 16) END AS unit FROM graph_entities""",
)
R.add(
    "g_least_confidence",
    lambda s, d: rel(s, d).select("source_id", G.edge_confidence(F.col("metadata"), F.lower(F.trim("type"))).alias("c")).distinct().groupBy("source_id").agg(F.collect_set("c").alias("c")).select("source_id", G.least_confidence(F.col("c")).alias("confidence")),  # four values at most
    """WITH c AS (SELECT source_id, lower(trim(type)) AS type, CASE WHEN json_valid(metadata) THEN try_cast(coalesce(json_extract_string(metadata, '$.confidence'), json_extract_string(metadata, '$.resolution_confidence')) AS DOUBLE) END AS c FROM graph_relationships),
r AS (SELECT source_id, min(CASE WHEN c >= 0.9 THEN 3 WHEN c >= 0.7 THEN 2 WHEN c >= 0.5 THEN 1 WHEN c IS NOT NULL THEN 0 WHEN type IN ('defines', 'contains', 'inherits') THEN 3 WHEN type IN ('calls', 'imports', 'references') THEN 2 ELSE 1 END) AS r FROM c GROUP BY 1)
SELECT source_id, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'inferred' END AS confidence FROM r""",
)
R.add("u_uncommitted", lambda s, d: G.uncommitted(rel(s, d).select("id").distinct(), rel(s, d).filter("metadata is not null").select("id")), "SELECT DISTINCT id FROM graph_relationships WHERE id NOT IN (SELECT id FROM graph_relationships WHERE metadata IS NOT NULL)")

QUERIES, ORACLES = R.queries, R.oracles
