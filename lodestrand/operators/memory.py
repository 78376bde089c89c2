"""Agent memory as DataFrames: scoring, tiers, promotion, status.

Items: id, agent_id, session_id, content, vector, importance, confidence, access_count, created_at, tier, status, subject.
`now` is always given, so results don't depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.prompts import metadata_score
from lodestrand.functions.text import keyword_similarity, keywords
from lodestrand.operators.search import ambiguity, cosine, similar_pairs

#: Decay of an episode's weight per hour, days after which recency is nothing, and weights of the adaptive strategy.
DECAY, FRESH_DAYS, ADAPTIVE = 0.029, 7.0, (0.5, 0.3, 0.2)
TIER_BOOST = {"working": 1.0, "episodic": 0.8, "semantic": 0.6}


def hours_since(time: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(time)) / 3.6e9)


def active(items: DataFrame, history: bool = False) -> DataFrame:
    """Items in force; with history also the negated and superseded ones. Filtered before any limit."""
    return items if history else items.filter(F.coalesce("status", F.lit("active")) == "active")


def tier_of(importance: Column, semantic: float = 0.9, episodic: float = 0.7) -> Column:
    return F.when(importance >= semantic, "semantic").when(importance >= episodic, "episodic").otherwise("working")


def relevance(items: DataFrame, query: Column, now: Column) -> DataFrame:
    """Items with score: similarity, mixed 7 to 3 with recency for episodes and with confidence for facts."""
    faded = F.exp(-DECAY * hours_since(F.col("created_at"), now))
    return _relevant(items.withColumn("__near", cosine(F.col("vector"), query)).withColumn("__faded", faded)).drop("__near", "__faded")


def _relevant(rows: DataFrame) -> DataFrame:
    near = F.col("__near")
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5))
    return rows.withColumn("score", F.when(F.col("tier") == "episodic", 0.7 * near + 0.3 * F.col("__faded")).when(F.col("tier") == "semantic", 0.7 * near + 0.3 * sure).otherwise(near))


def recency(time: Column, now: Column) -> Column:
    """1 now, 0 after a week, straight between."""
    return F.greatest(F.lit(0.0), 1 - hours_since(time, now) / (24 * FRESH_DAYS))


def retrieve(items: DataFrame, query: Column, now: Column, strategy: str = "relevance", limit: int = 10, history: bool = False, words: Column | None = None, weights: tuple[float, float, float] = ADAPTIVE, text: str = "") -> DataFrame:
    """The best items of all tiers by a strategy: relevance, recency, importance, adaptive (with weights), keyword (with words),
    metadata (whose values in the JSON column metadata the query's text names) or precision (words, values and 0.2 more for a
    subject that holds the text, 1 at most)."""
    rows = relevance(_prepared(active(items, history), strategy, now, words, text), query, now)
    rows = rows.withColumn("score", _score(strategy, weights)).drop(*_OWN)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def retrieve_all(items: DataFrame, queries: DataFrame, now: Column, strategy: str = "relevance", limit: int = 10, history: bool = False, words: Column | None = None, weights: tuple[float, float, float] = ADAPTIVE, text: str = "") -> DataFrame:
    """retrieve for many queries (query_id, query) at once: query_id, id, tier, score of the best of each.

    Every item meets every query, in blocks; what doesn't depend on the vector is worked out once for each item, and each task
    keeps the best of a query before the shuffle."""
    rows = _prepared(active(items, history), strategy, now, words, text).withColumn("__faded", F.exp(-DECAY * hours_since(F.col("created_at"), now)))
    rows = rows.select("id", "tier", "importance", "confidence", "vector", "__faded", *_OWN)
    pairs = _relevant(similar_pairs(rows, queries).withColumnRenamed("similarity", "__near")).withColumn("score", _score(strategy, weights))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= limit).select("query_id", "id", "tier", "score")


_OWN = ["__fresh", "__boost", "__told", "__values", "__same"]


def _prepared(items: DataFrame, strategy: str, now: Column, words: Column | None, text: str) -> DataFrame:
    """Items with the parts of their score that no vector has a say in."""
    boost = F.coalesce(F.create_map(*(x for k, v in TIER_BOOST.items() for x in (F.lit(k), F.lit(v))))[F.col("tier")], F.lit(0.5))
    told = keyword_similarity(F.array_distinct(keywords(F.col("content"))), words) if strategy in ("keyword", "precision") else F.lit(0.0)
    values = metadata_score(F.col("metadata"), F.lit(text)) if strategy in ("metadata", "precision") else F.lit(0.0)
    same = F.when((F.col("subject") != "") & F.lower("subject").contains(text.lower()), 0.2).otherwise(0.0) if strategy == "precision" else F.lit(0.0)
    return items.withColumns({"__fresh": recency(F.col("created_at"), now), "__boost": boost, "__told": told, "__values": values, "__same": same})


def _score(strategy: str, weights: tuple[float, float, float]) -> Column:
    """The score by a strategy, from the relevance (score) and the prepared parts."""
    score, fresh, importance = F.col("score"), F.col("__fresh"), F.col("importance")
    scores = {
        "relevance": score,
        "recency": fresh * F.col("__boost"),
        "importance": importance * F.greatest(F.lit(0.0), score),
        "adaptive": (weights[0] * score + weights[1] * fresh + weights[2] * importance) / sum(weights),
        "keyword": 0.7 * score + 0.3 * F.col("__told"),
        "metadata": 0.8 * score + 0.2 * F.col("__values"),
        "precision": F.least(F.lit(1.0), 0.5 * score + 0.3 * F.col("__told") + 0.2 * F.col("__values") + F.col("__same")),
    }
    if strategy not in scores:
        raise ValueError(f"unknown strategy: {strategy!r}")
    return scores[strategy]


def ambiguity_aware(items: DataFrame, query: Column, now: Column, limit: int = 10, words: Column | None = None, text: str = "", most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(results, ambiguity): the best by precision, and whether they are clear; of unclear ones `most` are given, else `limit`."""
    found = retrieve(items, query, now, "precision", max(limit, 2 * most), words=words, text=text)
    told = ambiguity(found.withColumn("file_path", F.coalesce("subject", F.lit(""))).withColumn("element_name", F.lit("")))
    n = F.when(F.col("ambiguous"), most).otherwise(limit)
    ranked = found.withColumn("__n", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # `limit` rows or so
    return ranked.crossJoin(F.broadcast(told.select(n.alias("__most")))).filter("__n <= __most").drop("__n", "__most"), told


def relation(query: str, subject: Column, content: Column, score: Column, told: Column, values: Column) -> Column:
    """How an item relates to a query: by its subject, its content, then by what carried its score (likeness, words, values)."""
    q, low = query.lower(), F.lower(F.nullif(subject, F.lit("")))
    holds = F.lower(content).contains(q)
    return (
        F.when(low == q, "exact_match")
        .when(low.contains(q) | F.contains(F.lit(q), low), "partial_match")
        .when(holds & (told > 0.7), "keyword_match")
        .when(holds, "contains_query")
        .when((score > 0.8) & (told < 0.3), "semantically_similar")
        .when(told > 0.5, "keyword_related")
        .when(values > 0.5, "metadata_related")
        .otherwise("related_to")
    )


def batch_retrieve(items: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, id, score: the items most similar to each of many queries (query_id, query), which are held against all in blocks."""
    pairs = similar_pairs(active(items).select("id", "vector"), queries, most=limit)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit).select("query_id", "id", F.col("similarity").alias("score"))


def facts(items: DataFrame, subject: str | None = None, relationship: str | None = None, object: str | None = None, limit: int = 100) -> DataFrame:
    """Facts by parts of their triple, surest first."""
    rows = items.filter(F.col("tier") == "semantic")
    for name, value in (("subject", subject), ("relationship", relationship), ("object", object)):
        rows = rows.filter(F.lower(name) == value.lower()) if value else rows
    return rows.orderBy(F.desc_nulls_last("confidence"), "id").limit(limit)


def latest_of_subject(items: DataFrame) -> DataFrame:
    """Without superseded items: the newest of each subject; items without a subject stay."""
    newest = Window.partitionBy("subject").orderBy(F.desc("created_at"), "id")
    known = items.filter("subject is not null").withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
    return known.unionByName(items.filter("subject is null"))


def promote(items: DataFrame, episodic: float = 0.8, semantic: float = 0.9) -> DataFrame:
    """Tiers after consolidation: working items from `episodic` importance become episodes; items from `semantic` importance,
    and episodes used more than once, become facts, as sure as importance and use allow."""
    working = F.col("tier") == "working"
    once = F.when(working & (F.col("importance") >= episodic), "episodic").otherwise(F.col("tier"))
    fact = (F.col("importance") >= semantic) | ((once == "episodic") & (F.col("access_count") > 1))
    new = F.when(F.col("tier") == "semantic", "semantic").when(fact, "semantic").otherwise(once)
    sure = F.least(F.lit(1.0), F.col("importance") * 0.7 + 0.3 * F.least(F.col("access_count") / 10, F.lit(1.0)))
    changed = (new == "semantic") & (F.col("tier") != "semantic")
    return items.withColumn("confidence", F.when(changed, sure).otherwise(F.col("confidence"))).withColumn("tier", new)


def decay(items: DataFrame, factor: float = 0.95) -> DataFrame:
    return items.withColumn("importance", F.greatest(F.lit(0.0), F.col("importance") * factor))


def set_status(items: DataFrame, ids: list[str], status: str) -> DataFrame:
    """Items with the status of some ids changed, for instance negated or superseded."""
    return items.withColumn("status", F.when(F.col("id").isin(ids), status).otherwise(F.col("status")))


def summary(content: Column, most: int = 150) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)


def tier_statistics(items: DataFrame) -> DataFrame:
    return items.groupBy("tier").agg(F.count("*").alias("items"), F.avg("importance").alias("importance"), F.max("created_at").alias("newest"))


def within_budget(items: DataFrame, budget: int, partition: list[str], order: list[Column], size: Column) -> DataFrame:
    """The leading rows of each partition whose running size stays within the budget: the first that doesn't fit ends it."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(window)).filter(F.col("used") <= budget)


def concepts(items: DataFrame, most: int = 10, candidates: int = 20) -> DataFrame:
    """The report of the `most` words that items use most: word, times, items (whose content has the word anywhere), importance
    (their mean times 1.1, at most 1), confidence (their share of all items).

    Words are runs between white space of more than three characters, with signs stripped off the ends, that occur more than
    once; ties go in alphabetical order. The chosen few are broadcast, so the contents cross no shuffle."""
    low = F.lower("content")
    words = items.select(F.explode(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3)).alias("w")).select(F.regexp_replace("w", r"""^[.,!?;:()\[\]{}"'-]+|[.,!?;:()\[\]{}"'-]+$""", "").alias("word"))
    top = words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "word").limit(candidates).filter("times > 1").orderBy(F.desc("times"), "word").limit(most)
    having = items.select(low.alias("low"), "importance").join(F.broadcast(top), F.contains(F.col("low"), F.col("word")))  # `most` rows
    sums = having.groupBy("word").agg(F.first("times").alias("times"), F.count("*").alias("items"), F.least(F.lit(1.0), F.avg("importance") * 1.1).alias("importance"))
    every = items.agg(F.count("*").alias("every"))  # one row
    return sums.crossJoin(F.broadcast(every)).select("word", "times", "items", "importance", F.least(F.lit(1.0), F.col("items") / F.col("every")).alias("confidence"))


def recall(memories: DataFrame, evidence: DataFrame, limit: int = 16) -> DataFrame:
    """Best memories and best evidence in turns (id, score, kind), each id once, memories first."""
    rows = memories.select("id", "score", F.lit("memory").alias("kind")).unionByName(evidence.select("id", "score", F.lit("evidence").alias("kind")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id")))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("kind")))).filter("first = 1").drop("first")
    return rows.orderBy("n", F.desc("kind"), "id").limit(limit).withColumn("position", F.row_number().over(Window.orderBy("n", F.desc("kind"), "id"))).drop("n")


# ------------------------------------------------------------------ writing and upkeep


def stored(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with new ones added (columns that these lack are null): summaries cut, tiers by importance where none is given. A new
    item with the id of an old one takes its place."""
    given = new if "tier" in new.columns else new.withColumn("tier", tier_of(F.col("importance")))
    given = given if "summary" in given.columns or "summary" not in items.columns else given.withColumn("summary", summary(F.col("content")))
    return items.join(new.select("id").distinct(), "id", "left_anti").unionByName(given, allowMissingColumns=True)


def feedback_items(feedback: DataFrame, importance: float = 0.7) -> DataFrame:
    """Feedback (id, agent_id, session_id, kind, content, created_at) as items of the episodic tier, with the kind as their subject."""
    return feedback.select("id", "agent_id", "session_id", "content", "created_at", F.lit(importance).alias("importance"), F.lit("episodic").alias("tier"), F.lit("active").alias("status"), F.concat(F.lit("feedback:"), F.coalesce("kind", F.lit("general"))).alias("subject"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """kind, n."""
    return feedback.groupBy(F.coalesce("kind", F.lit("general")).alias("kind")).agg(F.count("*").alias("n"))


def live_contexts(contexts: DataFrame, now: Column, seconds: float = 3600.0, touched: str = "last_active") -> DataFrame:
    """Contexts touched within so many seconds; ones never touched are stale."""
    return contexts.filter((F.unix_micros(now) - F.unix_micros(touched)) <= seconds * 1e6)


def conversation(items: DataFrame, sessions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest `limit` episodes of each session (session_id), as working items, oldest first by position."""
    rows = items.filter(F.col("tier") == "episodic").join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")))).filter(F.col("__n") <= limit)
    position = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("__n")))
    return rows.withColumn("position", position).withColumn("tier", F.lit("working")).drop("__n")


def cleared(items: DataFrame, agent: str, tier: str | None = None) -> DataFrame:
    """Items without those of an agent, or of one of its tiers."""
    gone = F.coalesce(F.col("agent_id") == agent, F.lit(False))
    return items.filter(~(gone & F.coalesce(F.col("tier") == tier, F.lit(False)) if tier else gone))


def within_capacity(items: DataFrame, capacity: int, partition: list[str], used: str = "last_used") -> DataFrame:
    """The `capacity` most recently used items of each partition; what was never used goes first."""
    order = Window.partitionBy(*partition).orderBy(F.desc_nulls_last(used), "id")
    return items.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= capacity).drop("__n")
