"""Vector, full-text and hybrid search over DataFrames of (id, ...).

A single query is a literal, so a search is one pass over the rows that the filters leave, with the best k kept in each
task (TakeOrderedAndProject); many queries are held against all rows in blocks, with the best k of each kept in each batch.
Corpus statistics are one row. All results have a total order: score, then id. Functions on result lists take keys, the columns
that tell the lists of several queries apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import WindowSpec
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestrand.functions.text import BOOST_STOP_WORDS, OVERVIEW_FILES, contains_any, file_priority

ZERO = 0.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(ZERO), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length, null or all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(ZERO))


def score_of_cosine(similarity: Column, mode: str = "clamp") -> Column:
    """Score of a cosine similarity c: clamp max(0, min(1, c)), half (c + 1) / 2, inverse 1 / (1 + (1 - c)), distance 1 - (1 - c) / 2."""
    if mode == "clamp":
        return F.greatest(F.lit(ZERO), F.least(F.lit(1.0), similarity))
    if mode in ("half", "distance"):
        return F.greatest(F.lit(ZERO), F.least(F.lit(1.0), (similarity + 1) / 2))
    if mode == "inverse":
        return 1 / (2 - similarity)
    raise ValueError(f"unknown score mode: {mode!r}")


def score_of_distance(distance: Column, metric: str = "cosine") -> Column:
    """Similarity of a distance: cosine clamped 1 - d, l2 1 / (1 + d), dot clamped (1 - d) / 2."""
    clamp = lambda c: F.greatest(F.lit(ZERO), F.least(F.lit(1.0), c))
    forms = {"cosine": clamp(1 - distance), "l2": 1 / (1 + distance), "dot": clamp((1 - distance) / 2)}
    if metric not in forms:
        raise ValueError(f"unknown metric: {metric!r}")
    return forms[metric]


def vector_search(df: DataFrame, query: list[float] | Column, limit: int = 10, vector: str = "vector", least: float | None = None, mode: str = "clamp") -> DataFrame:
    """The `limit` rows most similar to the query vector, with score and distance (1 - cosine)."""
    wanted = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    rows = df.withColumn("similarity", cosine(F.col(vector), wanted))
    rows = rows.withColumn("score", score_of_cosine(F.col("similarity"), mode)).withColumn("distance", 1 - F.col("similarity")).drop("similarity")
    if least is not None:
        rows = rows.filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


#: Queries that are held against all rows in one pass.
BLOCK = 4_096


def _blocks(queries: DataFrame) -> list[tuple[list, np.ndarray]]:
    """Queries (query_id, query) in blocks of about BLOCK unit vectors, by width; null and zero vectors have no likeness."""
    n = queries.count()
    parts = -(-n // BLOCK)
    out = []
    for part in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else queries
        held = rows.select("query_id", "query").toArrow()
        ids, vectors = held.column("query_id").to_pylist(), held.column("query").to_pylist()
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_width.setdefault(len(v or ()), []).append(i)
        for width, places in by_width.items():
            if width:
                out.append(([ids[i] for i in places], _unit(np.array([vectors[i] for i in places], np.float64))))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _compare(block, names: list[str], vector: str, most: int | None, kind):
    """For batches of rows: the columns `names`, query_id and similarity of every pair, or of the `most` best of each query."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = block.value
        for batch in batches:
            column = batch.column(vector)
            lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
            rows = np.flatnonzero(lengths == wanted.shape[1])
            flat = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), wanted.shape[1])
            rest = np.flatnonzero(lengths != wanted.shape[1])
            scores = np.concatenate([_unit(np.nan_to_num(flat)) @ wanted.T, np.zeros((len(rest), len(ids)))]).round(9)
            rows = np.concatenate([rows, rest])
            back = np.empty(len(rows), np.int64)
            back[rows] = np.arange(len(rows))
            scores = scores[back] + 0.0  # rows in order; no negative zero
            if most is None or most >= len(scores):
                row, query = np.repeat(np.arange(len(scores)), len(ids)), np.tile(np.arange(len(ids)), len(scores))
            else:  # all ties of the last place stay, as ids decide later
                last = np.partition(scores, len(scores) - most, axis=0)[len(scores) - most]
                row, query = np.nonzero(scores >= last)
            kept = batch.select(names).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([ids[q] for q in query], kind), pa.array(scores[row, query])], names=[*names, "query_id", "similarity"])

    return compare


def similar_pairs(df: DataFrame, queries: DataFrame, vector: str = "vector", most: int | None = None) -> DataFrame:
    """Columns of df but its vector, query_id, similarity (9 places): every row with every query (query_id, query) in blocks, one
    pass over df for each block. most: only each batch's best of a query, enough for the best of all. Rows whose vector is null,
    zero or of another length have similarity 0."""
    names = [c for c in df.columns if c != vector]
    kind = queries.schema["query_id"].dataType
    schema = StructType([df.schema[c] for c in names] + [StructField("query_id", kind), StructField("similarity", DoubleType())])
    parts = [df.mapInArrow(_compare(df.sparkSession.sparkContext.broadcast(block), names, vector, most, to_arrow_type(kind)), schema) for block in _blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def vector_search_all(df: DataFrame, queries: DataFrame, limit: int = 10, vector: str = "vector", least: float | None = None, mode: str = "clamp") -> DataFrame:
    """vector_search for many queries at once: the `limit` best rows of each, with query_id and score."""
    pairs = similar_pairs(df, queries, vector, limit).withColumn("score", score_of_cosine(F.col("similarity"), mode))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    pairs = pairs.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= limit).drop("__n", "similarity")
    return pairs if least is None else pairs.filter(F.col("score") >= least)


def terms_of(query: str) -> list[str]:
    """Distinct words of a query, lower-cased, in order."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def fraction_search(df: DataFrame, query: str, limit: int = 10, text: str = "content", least: float = 0.01) -> DataFrame:
    """Full-text search scored by the share of the query's words that the text contains."""
    words = list(dict.fromkeys(query.lower().split()))
    low = F.lower(text)
    score = reduce(lambda a, b: a + b, (F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) / max(len(words), 1)
    return df.withColumn("score", score.cast("double")).filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def _unlike(word: str):
    return lambda x: x != word


def bm25_search(df: DataFrame, query: str, limit: int = 10, text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Full-text search scored by BM25 with statistics of all rows of df; rows without any word of the query drop out.

    Two passes over the text and no shuffle of it: the counts, one row, meet each row by a broadcast.
    """
    words = terms_of(query)
    tokens = df.withColumn("__w", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(\w+)")))
    tokens = tokens.withColumn("__n", F.size("__w"))
    for i, w in enumerate(words):
        tokens = tokens.withColumn(f"__t{i}", F.size("__w") - F.size(F.filter("__w", _unlike(w))))
    tokens = tokens.drop("__w")
    sums = tokens.agg(F.count("*").alias("__rows"), F.avg("__n").alias("__mean"), *(F.count_if(F.col(f"__t{i}") > 0).alias(f"__d{i}") for i in range(len(words))))
    rows = tokens.filter(reduce(lambda x, y: x | y, (F.col(f"__t{i}") > 0 for i in range(len(words))), F.lit(False))).crossJoin(F.broadcast(sums))  # one row
    part = lambda i: F.log(1 + (F.col("__rows") - F.col(f"__d{i}") + 0.5) / (F.col(f"__d{i}") + 0.5)) * F.col(f"__t{i}") * (k1 + 1) / (F.col(f"__t{i}") + k1 * (1 - b + b * F.col("__n") / F.col("__mean")))
    score = reduce(lambda x, y: x + y, (part(i) for i in range(len(words))), F.lit(ZERO))
    return rows.withColumn("score", score).select(*df.columns, "score").orderBy(F.desc("score"), "id").limit(limit)


# ------------------------------------------------------------- short result lists


def by_maximum(df: DataFrame, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Scores divided by the largest of the list (of each key); a list of zeros stays so."""
    top = F.max(score).over(Window.partitionBy(*(keys or [F.lit(0)])))
    return df.withColumn(score, F.when(top > 0, F.col(score) / top).otherwise(F.col(score)))


def by_range(df: DataFrame, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Scores spread over 0 to 1; equal scores become 1, all zero stay 0."""
    window = Window.partitionBy(*(keys or [F.lit(0)]))
    low, high = F.min(score).over(window), F.max(score).over(window)
    return df.withColumn(score, F.when(high == low, F.when(high == 0, 0.0).otherwise(1.0)).otherwise((F.col(score) - low) / (high - low)))


def _by(keys: list[str] | None, *order) -> WindowSpec:
    """Window over each list: of its keys, or over one short list."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)


def fuse_by_rank(vector: DataFrame, text: DataFrame, k: int = 60, weights: tuple[float, float] = (0.7, 0.3), bonus: float = 1.3, keys: list[str] | None = None) -> DataFrame:
    """id, score: reciprocal ranks weighted by source and by max(0.1, score), more for ids of both lists, over the largest."""
    keys, parts = keys or [], []
    for df, weight in ((vector, weights[0]), (text, weights[1])):
        rows = df.select(*keys, "id", "score").withColumn("rank", F.row_number().over(_by(keys, F.desc("score"), "id")))
        parts.append(rows.select(*keys, "id", (weight * F.greatest(F.lit(0.1), F.col("score")) / (k + F.col("rank"))).alias("part")))
    sums = parts[0].unionByName(parts[1]).groupBy(*keys, "id").agg(F.sum("part").alias("sum"), F.count("*").alias("lists"))
    return by_maximum(sums.select(*keys, "id", (F.col("sum") * F.when(F.col("lists") > 1, bonus).otherwise(1.0)).alias("score")), keys=keys)


def fuse_by_weight(vector: DataFrame, text: DataFrame, weights: tuple[float, float] = (0.7, 0.3), scaled: bool = True, keys: list[str] | None = None) -> DataFrame:
    """id, score: weighted sum of the scores, 0 where a list lacks the id; over the largest, or cut at 1."""
    keys = keys or []
    a, b = vector.select(*keys, "id", F.col("score").alias("v")), text.select(*keys, "id", F.col("score").alias("t"))
    rows = a.join(b, [*keys, "id"], "full").select(*keys, "id", (weights[0] * F.coalesce("v", F.lit(ZERO)) + weights[1] * F.coalesce("t", F.lit(ZERO))).alias("score"))
    return by_maximum(rows, keys=keys) if scaled else rows.withColumn("score", F.least(F.lit(1.0), F.col("score")))


def merge_first(vector: DataFrame, text: DataFrame, limit: int = 10, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """id, score, source: weighted scores of both lists, an id of both as the vector search found it, the best `limit`."""
    rows = vector.select("id", (weights[0] * F.col("score")).alias("score"), F.lit("vector").alias("source"))
    others = text.select("id", (weights[1] * F.col("score")).alias("score"), F.lit("text").alias("source")).join(rows.select("id"), "id", "left_anti")
    return rows.unionByName(others).orderBy(F.desc("score"), "id").limit(limit)


def in_both(vector: DataFrame, text: DataFrame) -> DataFrame:
    """id: what both searches found."""
    return vector.select("id").intersect(text.select("id"))


FUSIONS = {"rrf": fuse_by_rank, "linear": fuse_by_weight}


def boost_overview(df: DataFrame, factor: float = 1.5, path: str = "file_path") -> DataFrame:
    """Scores of files that introduce something times `factor`, 1 at most."""
    return df.withColumn("score", F.when(contains_any(F.lower(path), OVERVIEW_FILES), F.least(F.lit(1.0), F.col("score") * factor)).otherwise(F.col("score")))


def boost_type(df: DataFrame, wanted: str, weight: float = 0.2) -> DataFrame:
    return df.withColumn("score", F.when(F.lower("content_type") == wanted.lower(), F.least(F.lit(1.0), F.col("score") * (1 + weight))).otherwise(F.col("score")))


def query_words(query: str) -> list[str]:
    """Distinct terms of a query, lower-cased: identifiers are parted, stop words and single characters left out."""
    parted = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[_-]", " ", query))
    parted = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", parted)
    return [w for w in dict.fromkeys(parted.lower().split()) if len(w) > 1 and w not in BOOST_STOP_WORDS]


def boost_content(df: DataFrame, query: str, factor: float = 1.5, text: str = "content", path: str = "file_path", keys: list[str] | None = None) -> DataFrame:
    """Scores of a result list raised by the terms of the query that a result's text or path contains, over the largest then.

    A term weighs the inverse of the share of results that have it, 20 at most. A score is multiplied by 1 to `factor`, in step
    with the share of the weight that the result has; from half of the weight on, it is at least the list's top score so
    multiplied. The sums are one row a list."""
    words = query_words(query)
    if not words:
        return df
    low = F.concat_ws(" ", F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(path), F.lit(""))))
    rows = df.withColumn("__low", low)
    for i, w in enumerate(words):
        rows = rows.withColumn(f"__h{i}", F.col("__low").contains(w).cast("int"))
    sums = rows.groupBy(*(keys or [])).agg(F.max("score").alias("__top"), *((1 / F.greatest(F.lit(0.05), F.avg(f"__h{i}"))).alias(f"__w{i}") for i in range(len(words))))
    rows = rows.drop("__low").join(sums, keys) if keys else rows.drop("__low").crossJoin(F.broadcast(sums))
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    share = add(F.col(f"__h{i}") * F.col(f"__w{i}") for i in range(len(words))) / add(F.col(f"__w{i}") for i in range(len(words)))
    rows = rows.withColumn("__s", share).withColumn("__gain", 1 + (factor - 1) * F.col("__s"))
    raised = F.col("score") * F.col("__gain")
    rows = rows.withColumn("score", F.when(F.col("__s") >= 0.5, F.greatest(raised, F.col("__top") * F.col("__gain"))).otherwise(raised)).select(*df.columns)
    return by_maximum(rows, keys=keys)


def best_of_file(df: DataFrame, most: int = 1, path: str = "file_path", keys: list[str] | None = None) -> DataFrame:
    """The best rows of each file."""
    return df.withColumn("__n", F.row_number().over(_by([*(keys or []), path], F.desc("score"), "id"))).filter(F.col("__n") <= most).drop("__n")


def best_of_list(df: DataFrame, limit: int, keys: list[str] | None = None) -> DataFrame:
    """The best rows of each list."""
    if not keys:
        return df.orderBy(F.desc("score"), "id").limit(limit)
    return df.withColumn("__n", F.row_number().over(_by(keys, F.desc("score"), "id"))).filter(F.col("__n") <= limit).drop("__n")


def second_order(df: DataFrame, gap: float = 0.01, time: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """position: results whose scores follow each other within `gap` are one group, ordered by kind of file, then newest."""
    first = _by(keys, F.desc("score"), "id")
    rows = df.withColumn("__new", F.when(F.lag("score").over(first) - F.col("score") > gap, 1).otherwise(0))
    rows = rows.withColumn("__group", F.sum("__new").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    newest = [F.desc(time)] if time else []
    order = _by(keys, "__group", file_priority(F.col("file_path")), *newest, F.desc("score"), "id")
    return rows.withColumn("position", F.row_number().over(order)).drop("__new", "__group")


def round_robin(df: DataFrame, limit: int, most: int = 2) -> DataFrame:
    """Results taken in turns from each file, `most` of a file, in order of the files' best."""
    rows = df.withColumn("__n", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id")))
    rows = rows.withColumn("__best", F.max("score").over(Window.partitionBy("file_path")))
    rows = rows.filter(F.col("__n") <= most).orderBy("__n", F.desc("__best"), "file_path", "id").limit(limit)
    order = Window.orderBy("__n", F.desc("__best"), "file_path", "id")
    return rows.withColumn("position", F.row_number().over(order)).drop("__n", "__best")


def diversity(df: DataFrame) -> DataFrame:
    """diversity: distinct files over rows, 0 without rows."""
    return df.agg((F.countDistinct("file_path") / F.nullif(F.count("*"), F.lit(0))).alias("d")).select(F.coalesce("d", F.lit(ZERO)).alias("diversity"))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def ambiguity(df: DataFrame, near: float = 0.1, least: float = 0.4, name: str = "element_name") -> DataFrame:
    """One row (ambiguous, reason, matches): no results, a low top score, or several files or names within `near` of it."""
    top = df.agg(F.max("score").alias("top"))
    close = df.crossJoin(F.broadcast(top)).filter(F.col("top") - F.col("score") <= near)  # one row
    sums = close.agg(
        F.max("top").alias("top"),
        F.count("*").alias("n"),
        F.countDistinct(F.nullif(F.col("file_path"), F.lit(""))).alias("files"),
        F.countDistinct(F.nullif(F.col(name), F.lit(""))).alias("names"),
    )
    reason = F.when(F.col("top").isNull(), "no_results").when(F.col("top") < least, "low_confidence").when((F.col("n") > 1) & ((F.col("files") > 1) | (F.col("names") > 1)), "multiple_matches")
    return sums.select(reason.isNotNull().alias("ambiguous"), reason.alias("reason"), F.when(reason == "multiple_matches", F.col("n")).otherwise(0).cast("long").alias("matches"))


def hybrid_search(
    df: DataFrame, query: str, vector: list[float] | Column | DataFrame, limit: int = 10, fusion: str = "rrf", per_file: int | None = 1, overview: bool = False, content_factor: float = 1.5,
    prefer: str | None = None, ranks: DataFrame | None = None, rank_weight: float = 0.0, text_search=fraction_search, floors: tuple[float, float] = (0.15, 0.01),
) -> DataFrame:
    """The pipeline: both searches, three times as deep as asked, above their floors; scores over their maximum; fusion;
    boosts; the best of each file; the cut. ranks: (doc_id, pagerank) blended in by rank_weight. Adds score, position.

    vector: one vector, or a DataFrame of many (query_id, query), which adds query_id: all are searched in one pass for a
    block, with the same text. Only ids and scores are ranked and fused; texts are fetched for what is left."""
    deep, many = 3 * limit, isinstance(vector, DataFrame)
    keys = ["query_id"] if many else None
    told = by_maximum(text_search(df, query, deep).filter(F.col("score") >= floors[1]).select("id", "score"))
    if many:
        narrow = df.select("id", "vector")
        found = by_maximum(vector_search_all(narrow, vector, deep, least=floors[0]).select("query_id", "id", "score"), keys=keys)
        told = told.crossJoin(vector.select("query_id"))  # `deep` rows for each query
    else:
        found = by_maximum(vector_search(df, vector, deep, least=floors[0]).select("id", "score"))
    fused = FUSIONS[fusion](found, told, keys=keys)
    rows = df.drop("vector").join(fused, "id") if many else df.join(F.broadcast(fused), "id")  # six times `limit` rows a query at most
    rows = boost_content(rows, query, content_factor, keys=keys)
    if overview:
        rows = boost_overview(rows)
    if prefer:
        rows = boost_type(rows, prefer)
    if ranks is not None:
        rows = blend_rank(rows, ranks, rank_weight)
    if per_file:
        rows = best_of_file(rows, per_file, keys=keys)
    return second_order(best_of_list(rows, limit, keys), keys=keys)


def blend_rank(df: DataFrame, ranks: DataFrame, weight: float) -> DataFrame:
    """Scores mixed with the best pagerank of the document's entities: (1 - weight) score + weight rank."""
    best = ranks.groupBy("doc_id").agg(F.max("pagerank").cast("double").alias("__rank"))
    return df.join(best, "doc_id", "left").withColumn("score", (1 - weight) * F.col("score") + weight * F.coalesce("__rank", F.lit(ZERO))).drop("__rank")


def with_entities(df: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """Results with the names of up to `most` entities of their document, sorted."""
    names = entities.filter("doc_id <> ''").select("doc_id", "name").distinct()
    names = names.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))).filter(F.col("__n") <= most)
    lists = names.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("entities"))
    return df.join(lists, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.lit("")))


def scan_lines(df: DataFrame, needle: str, context: int = 2, path: str = "file_path", text: str = "content") -> DataFrame:
    """Fixed-string search, case apart: file, line number, line and the lines around it."""
    rows = df.filter(F.lower(text).contains(needle.lower())).withColumn("__l", F.split(text, "\n"))
    rows = rows.select("id", path, "__l", F.posexplode("__l").alias("__at", "line"))
    around = F.array_join(F.slice("__l", F.greatest(F.lit(1), F.col("__at") + 1 - context), F.least(F.col("__at"), F.lit(context)) + 1 + context), "\n")
    return rows.filter(F.lower("line").contains(needle.lower())).select("id", path, (F.col("__at") + 1).alias("line_number"), "line", around.alias("around"), F.lit(1.0).alias("score"))


# ---- fixed values: weights of vector and text search by strategy
STRATEGIES = {"fallback_only": (0.0, 1.0), "hybrid_fallback_primary": (0.3, 0.7), "semantic_primary": (0.7, 0.3), "semantic_only": (1.0, 0.0)}
# ----


def strategy_weights(strategy: str) -> tuple[float, float]:
    """Weights of vector and text search; even for an unknown strategy."""
    return STRATEGIES.get(strategy, (0.5, 0.5))


def refinements(facets: dict[str, list[str]], filters: dict) -> list[str]:
    """Ways to narrow a search: by facets of more than one value that no filter names yet, and by common terms."""
    forms = [("type", "Narrow results by type: ", 3), ("language", "Filter by language: ", 3), ("directory", "Focus on specific directories: ", 3)]
    out = [lead + ", ".join(facets[name][:most]) for name, lead, most in forms if len(facets.get(name, ())) > 1 and name not in filters]
    terms = facets.get("terms") or []
    return out + ["Refine query with: " + ", ".join(terms[:5])] if terms else out
