"""Event and memory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import keywords
from lodestrand.operators import events as E
from lodestrand.operators import memory as M
from lodestrand.plans.registry import Registry
from lodestrand.plans.search_queries import questions
from lodestrand.plans.text_queries import kw
from lodestrand.sources.tables import table

R = Registry()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as operation events: a user is an operation, the type says the status."""
    rows = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("operation_id"), "event_type", "value", status.alias("status"))


EV = """ev AS (SELECT event_id, ts, user_id AS operation_id, event_type, value,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS status FROM events)"""
R.add(
    "t_events",
    lambda s, d: E.select_events(events(s, d), kind="click", since="2024-01-02 00:00:00", until="2024-01-20 00:00:00", limit=100).select("event_id", "operation_id"),
    f"WITH {EV} SELECT event_id, operation_id FROM ev WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100",
)
R.add(
    "a_operations",
    lambda s, d: E.operations(events(s, d)).select("operation_id", F.unix_micros("started").alias("started"), F.unix_micros("last").alias("last"), "events", "failed", "last_type", "last_status"),
    f"""WITH {EV} SELECT operation_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last, count(*) AS events, count(*) FILTER (status = 'failed') AS failed,
  arg_max(event_type, (ts, event_id)) AS last_type, arg_max(status, (ts, event_id)) AS last_status FROM ev GROUP BY operation_id""",
)
R.add(
    "j_open_operations",
    lambda s, d: E.open_operations(events(s, d)).select("operation_id", F.unix_micros("begun").alias("begun"), "progress"),
    f"""WITH {EV}, b AS (SELECT operation_id, max(ts) AS begun FROM ev WHERE status = 'started' GROUP BY 1), x AS (SELECT operation_id, max(ts) AS ended FROM ev WHERE status IN ('completed', 'failed') GROUP BY 1),
p AS (SELECT operation_id, count(*) AS n FROM ev WHERE status = 'progress' GROUP BY 1)
SELECT b.operation_id, epoch_us(begun) AS begun, coalesce(n, 0) AS progress FROM b LEFT JOIN x ON x.operation_id = b.operation_id LEFT JOIN p ON p.operation_id = b.operation_id WHERE ended IS NULL OR ended < begun""",
)
R.add(
    "a_progress",
    lambda s, d: E.progress(events(s, d), ["click", "error", "view"]),
    f"WITH {EV} SELECT operation_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view FROM ev GROUP BY 1",
)
_LAT = f"""{EV}, l AS (SELECT event_type, list(value ORDER BY value) AS v FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1),
p AS (SELECT event_type, CAST(len(v) AS INTEGER) AS samples, {', '.join(f'v[least(CAST(floor(len(v) * {q}) AS INTEGER) + 1, len(v))] AS {n}' for n, q in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99)))} FROM l)"""
R.add("a_latency", lambda s, d: E.latency(events(s, d), "event_type", "value"), f"WITH {_LAT} SELECT * FROM p")
R.add("a_health", lambda s, d: E.health(E.latency(events(s, d), "event_type", "value")).agg(E.worst(F.col("health")).alias("health")), f"WITH {_LAT} SELECT CASE max(CASE WHEN p95 >= 2 THEN 2 WHEN p95 >= 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS health FROM p")
R.add("a_errors", lambda s, d: E.errors(events(s, d), ["operation_id"]), f"WITH {EV} SELECT operation_id, count(*) AS errors FROM ev WHERE status = 'failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
R.add("t_slow", lambda s, d: E.slow(events(s, d), "value", 50).select("event_id", "value"), f"WITH {EV} SELECT event_id, value FROM ev WHERE value >= 50 ORDER BY value DESC, event_id LIMIT 20")
R.add(
    "r_sampled",
    lambda s, d: E.sampled(events(s, d), 10).select("event_id", "status"),
    f"WITH {EV} SELECT event_id, status FROM ev QUALIFY status <> 'progress' OR row_number() OVER (PARTITION BY operation_id, status = 'progress' ORDER BY ts, event_id) % 10 = 0",
)
R.add(
    "w_calls",
    lambda s, d: E.calls_in_window(events(s, d), "operation_id", 3600).select("event_id", "calls"),
    f"WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY operation_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS calls FROM ev",
)
_ADMIT = """WITH RECURSIVE {ev}, o AS (SELECT operation_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY operation_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT operation_id, n, event_id, true AS kept, [t] AS held FROM o WHERE n = 1
  UNION ALL SELECT o.operation_id, o.n, o.event_id, len(list_filter(f.held, lambda x: x > o.t - {span})) < {most},
    CASE WHEN len(list_filter(f.held, lambda x: x > o.t - {span})) < {most} THEN list_append(list_filter(f.held, lambda x: x > o.t - {span}), o.t) ELSE list_filter(f.held, lambda x: x > o.t - {span}) END
  FROM f JOIN o ON o.operation_id = f.operation_id AND o.n = f.n + 1)
SELECT operation_id, event_id FROM f WHERE kept"""
R.add("r_rate_limited", lambda s, d: E.rate_limited(events(s, d), "operation_id", 3, 43200), _ADMIT.format(ev=EV, span=43_200_000_000, most=3))
R.add("r_debounced", lambda s, d: E.debounced(events(s, d), "operation_id", 21600), _ADMIT.format(ev=EV, span=21_600_000_000, most=1))
R.add(
    "r_settled",
    lambda s, d: E.settled(events(s, d), "operation_id", 21600).select("operation_id", F.unix_micros("began").alias("began"), "events", "event_id"),
    f"""WITH {EV}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY operation_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY operation_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT operation_id, epoch_us(min(ts)) AS began, count(*) AS events, arg_max(event_id, (ts, event_id)) AS event_id FROM b GROUP BY operation_id, burst""",
)
R.add("r_retained", lambda s, d: E.retained(events(s, d), F.lit("2024-01-15").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n")), f"WITH {EV} SELECT event_type, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
R.add("x_strategy", lambda s, d: events(s, d).select("event_id", E.strategy(F.col("value")).alias("strategy")), f"WITH {EV} SELECT event_id, CASE WHEN value < 10 THEN 'scan' WHEN value < 50 THEN 'text' WHEN value < 80 THEN 'mixed' ELSE 'hybrid' END AS strategy FROM ev")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Session memos and meeting notes as memory items; their vectors are those of the whole embeddings table, in turn."""
    docs = table(spark, folder, "documents").filter(F.col("doc_kind").isin("session_memo", "meeting_note") & F.col("text").isNotNull())
    vectors = table(spark, folder, "embeddings")
    size = vectors.agg((F.max("vec_id") + 1).alias("size"))  # one row
    k = F.col("doc_id") % 100
    rows = docs.crossJoin(F.broadcast(size)).select(
        F.col("doc_id").alias("id"), F.col("source").alias("agent_id"), F.col("text").alias("content"), (k / 100).alias("importance"), F.when(k % 7 == 0, None).otherwise((k % 10) / 10).alias("confidence"),
        (F.col("doc_id") % 14).alias("access_count"), F.col("created_at").cast("timestamp").alias("created_at"), M.tier_of(k / 100).alias("tier"), F.when(F.col("doc_id") % 11 == 0, "negated").otherwise("active").alias("status"),
        F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat_ws(":", "source", "doc_kind")).alias("subject"), (F.col("doc_id") % F.col("size")).alias("vec_id"),
        F.concat(F.lit('{"tags": ["'), F.col("source"), F.lit('", "'), F.coalesce("lang", F.lit("")), F.lit('"], "type": "'), F.col("doc_kind"), F.lit('"}')).alias("metadata"),
    )
    return rows.join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id")


IT = """items AS (SELECT doc_id AS id, source AS agent_id, text AS content, (doc_id % 100) / 100 AS importance, CASE WHEN (doc_id % 100) % 7 = 0 THEN NULL ELSE ((doc_id % 100) % 10) / 10 END AS confidence,
  doc_id % 14 AS access_count, created_at, CASE WHEN (doc_id % 100) / 100 >= 0.9 THEN 'semantic' WHEN (doc_id % 100) / 100 >= 0.7 THEN 'episodic' ELSE 'working' END AS tier, doc_kind, lang, source,
  CASE WHEN doc_id % 11 = 0 THEN 'negated' ELSE 'active' END AS status, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ':' || doc_kind END AS subject, embedding AS vector
  FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT max(vec_id) + 1 FROM embeddings) WHERE doc_kind IN ('session_memo', 'meeting_note') AND text IS NOT NULL),
q AS (SELECT vec_id AS query_id, embedding AS wanted, (SELECT max(created_at) FROM documents) AS now FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, items.*, round(list_cosine_similarity(vector::DOUBLE[], wanted::DOUBLE[]), 9) AS near, (epoch_us(now) - epoch_us(created_at)) / 3.6e9 AS hours FROM items, q),
r AS (SELECT *, CASE tier WHEN 'episodic' THEN 0.7 * near + 0.3 * exp(-0.029 * hours) WHEN 'semantic' THEN 0.7 * near + 0.3 * coalesce(nullif(confidence, 0), 0.5) ELSE near END AS rel,
  greatest(0, 1 - hours / 168) AS fresh FROM s WHERE status = 'active')"""
ASKED = "session_memo on a stale patient in en"


def _memory(strategy: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        now = table(spark, folder, "documents").agg(F.max(F.col("created_at").cast("timestamp")).alias("now"))
        rows = items(spark, folder).crossJoin(F.broadcast(now))  # one row
        given = {"words": F.array(F.lit("session"), F.lit("stale"), F.lit("patient")), "text": ASKED}
        found = M.retrieve_all(rows, questions(spark, folder), F.col("now"), strategy, 25, **given)
        return found.select("query_id", "id", "tier", F.round("score", 6).alias("score"))

    return run


_WORDS_OF_ITEM = f"(SELECT id, list_distinct({kw('content')}) AS w FROM items)"
for _name, _sql in (
    ("relevance", "rel"),
    ("recency", "fresh * CASE tier WHEN 'working' THEN 1.0 WHEN 'episodic' THEN 0.8 ELSE 0.6 END"),
    ("importance", "importance * greatest(0, rel)"),
    ("adaptive", "0.5 * rel + 0.3 * fresh + 0.2 * importance"),
    ("keyword", "0.7 * rel + 0.3 * len(list_intersect(w, ['session', 'stale', 'patient'])) / (len(w) + 3 - len(list_intersect(w, ['session', 'stale', 'patient'])))"),
    ("metadata", f"0.8 * rel + 0.2 * (CAST(contains('{ASKED}', lower(source)) OR contains('{ASKED}', lower(coalesce(lang, ''))) AS INTEGER) + CAST(contains('{ASKED}', lower(doc_kind)) AS INTEGER)) / 2"),
):
    _from = f"(SELECT r.*, w FROM r JOIN {_WORDS_OF_ITEM} k ON k.id = r.id) r" if _name == "keyword" else "r"
    R.add(f"m_{_name}", _memory(_name), f"WITH {IT} SELECT query_id, id, tier, round({_sql}, 6) AS score FROM {_from} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_sql} DESC, id) <= 25")
R.add(
    "m_batch",
    lambda s, d: M.batch_retrieve(items(s, d), questions(s, d), 5).select("query_id", "id", F.round("score", 6).alias("score")),
    f"WITH {IT} SELECT query_id, id, round(near, 6) AS score FROM s WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id) <= 5",
)
R.add("w_latest_of_subject", lambda s, d: M.latest_of_subject(items(s, d)).select("id", "subject"), f"WITH {IT} SELECT id, subject FROM items QUALIFY subject IS NULL OR row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id) = 1")
R.add(
    "m_promote",
    lambda s, d: M.promote(items(s, d)).select("id", "tier", F.round("confidence", 6).alias("confidence")),
    f"""WITH {IT}, o AS (SELECT *, CASE WHEN tier = 'working' AND importance >= 0.8 THEN 'episodic' ELSE tier END AS once FROM items),
n AS (SELECT *, CASE WHEN tier = 'semantic' OR importance >= 0.9 OR (once = 'episodic' AND access_count > 1) THEN 'semantic' ELSE once END AS fresh FROM o)
SELECT id, fresh AS tier, round(CASE WHEN fresh = 'semantic' AND tier <> 'semantic' THEN least(1, importance * 0.7 + 0.3 * least(access_count / 10, 1.0)) ELSE confidence END, 6) AS confidence FROM n""",
)
R.add("m_decay", lambda s, d: M.decay(items(s, d)).select("id", F.round("importance", 6).alias("importance")), f"WITH {IT} SELECT id, round(greatest(0, importance * 0.95), 6) AS importance FROM items")
R.add("m_facts", lambda s, d: M.facts(items(s, d).withColumn("relationship", F.lit("is")).withColumn("object", F.lit("x")), relationship="IS", limit=20).select("id"), f"WITH {IT} SELECT id FROM items WHERE tier = 'semantic' ORDER BY confidence DESC NULLS LAST, id LIMIT 20")
R.add("a_tiers", lambda s, d: M.tier_statistics(items(s, d)).select("tier", "items", F.round("importance", 6).alias("importance"), F.unix_micros("newest").alias("newest")), f"WITH {IT} SELECT tier, count(*) AS items, round(avg(importance), 6) AS importance, epoch_us(max(created_at)) AS newest FROM items GROUP BY 1")
R.add(
    "w_budget",
    lambda s, d: M.within_budget(items(s, d), 4000, ["agent_id"], [F.desc("importance"), F.col("id")], F.length("content")).select("agent_id", "id", "used"),
    f"WITH {IT}, u AS (SELECT agent_id, id, CAST(sum(length(content)) OVER (PARTITION BY agent_id ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM items) SELECT * FROM u WHERE used <= 4000",
)
R.add("m_summary", lambda s, d: items(s, d).select("id", M.summary(F.col("content")).alias("summary")), f"WITH {IT} SELECT id, CASE WHEN length(content) > 150 THEN substring(content, 1, 150) || '...' ELSE content END AS summary FROM items")
R.add(
    "a_concepts",
    lambda s, d: M.concepts(items(s, d)).select("word", "times", "items", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence")),
    f"""WITH {IT}, w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: length(w) > 3)) AS w FROM items),
c AS (SELECT regexp_replace(regexp_replace(w, '^[.,!?;:()\\[\\]{{}}"''-]+', ''), '[.,!?;:()\\[\\]{{}}"''-]+$', '') AS word, count(*) AS times FROM w GROUP BY 1 HAVING word <> ''),
t AS (SELECT * FROM (SELECT * FROM c ORDER BY times DESC, word LIMIT 20) WHERE times > 1 ORDER BY times DESC, word LIMIT 10)
SELECT word, times, count(*) AS items, round(least(1, avg(importance) * 1.1), 6) AS importance, round(least(1, count(*) / (SELECT count(*) FROM items)), 6) AS confidence
FROM t JOIN items ON contains(lower(content), word) GROUP BY ALL""",
)
R.add("m_recall", lambda s, d: M.recall(items(s, d).select("id", F.col("importance").alias("score")).orderBy(F.desc("score"), "id").limit(20), items(s, d).select("id", F.size(keywords(F.col("content"))).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(20)))

QUERIES, ORACLES = R.queries, R.oracles
