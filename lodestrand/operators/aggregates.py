"""Aggregations over chunks and entities: statistics, facets, keywords, activity, naming patterns, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import entity_type, extension, folder, keywords, words_of_name
from lodestrand.sources.tables import instant


def project_statistics(chunks: DataFrame) -> DataFrame:
    """By project: chunks, files, languages, newest index time."""
    return chunks.groupBy("project_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.nullif(F.trim("language"), F.lit(""))).alias("languages"), F.max(instant("indexed_at")).alias("newest")
    )


def facet(df: DataFrame, value: Column, name: str, limit: int = 10) -> DataFrame:
    """The most frequent values of one facet: facet, value, n."""
    rows = df.select(value.alias("value")).filter("value is not null and value <> ''")
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit).select(F.lit(name).alias("facet"), "value", "n")


def facets(df: DataFrame, limit: int = 10) -> DataFrame:
    """Facets by content type, language (or suffix), folder and keyword."""
    kinds = {
        "content_type": F.lower("content_type"),
        "language": F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), extension(F.col("file_path"))),
        "folder": folder(F.col("file_path")),
        "term": F.explode(F.array_distinct(keywords(F.col("content")))),
    }
    return reduce(DataFrame.unionByName, (facet(df, value, name, limit) for name, value in kinds.items()))


def top_keywords(df: DataFrame, limit: int = 20, text: str = "content", source: str = "file_path") -> DataFrame:
    """The most frequent keywords with the number of sources they occur in.

    Counted per source first, so that frequent words are summed before they are shuffled."""
    each = df.select(source, F.explode(keywords(F.col(text))).alias("keyword")).groupBy("keyword", source).agg(F.count("*").alias("n"))
    return each.groupBy("keyword").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).orderBy(F.desc("n"), "keyword").limit(limit)


def file_activity(chunks: DataFrame, cutoff: Column | None = None, time: str = "source_modified_at") -> DataFrame:
    """By file: chunks, first and last change; from `cutoff` on."""
    rows = chunks.select("project_id", "file_path", instant(time).alias("at")).filter("at is not null")
    rows = rows.filter(F.col("at") >= cutoff) if cutoff is not None else rows
    return rows.groupBy("project_id", "file_path").agg(F.count("*").alias("chunks"), F.min("at").alias("first"), F.max("at").alias("last"))


def hot_folders(chunks: DataFrame, cutoff: Column, limit: int = 10) -> DataFrame:
    """Folders with the most files changed since the cutoff."""
    files = file_activity(chunks, cutoff).withColumn("folder", folder(F.col("file_path")))
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.max("last").alias("last")).orderBy(F.desc("files"), "folder").limit(limit)


def stale_folders(chunks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Folders whose newest change is older than `days`: folder, oldest and newest change, days since the newest."""
    files = file_activity(chunks).withColumn("folder", folder(F.col("file_path")))
    sums = files.groupBy("folder").agg(F.min("first").alias("oldest"), F.max("last").alias("newest"))
    return sums.withColumn("days", F.datediff(now, "newest")).filter(F.col("days") > days)


def types_count(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy(F.lower(F.trim("type")).alias("type")).agg(F.count("*").alias("n"))


def naming_patterns(entities: DataFrame, least: int = 3) -> DataFrame:
    """First and last words that at least `least` names of a type share: type, side, word, names."""
    words = words_of_name(F.col("name"))
    rows = entities.select("id", entity_type(F.col("type")).alias("type"), words.alias("w")).filter(F.size("w") > 1).distinct()
    ends = F.explode(F.array(F.struct(F.lit("first").alias("side"), F.element_at("w", 1).alias("word")), F.struct(F.lit("last").alias("side"), F.element_at("w", -1).alias("word"))))
    return rows.select("id", "type", ends.alias("e")).groupBy("type", "e.side", "e.word").agg(F.count("*").alias("names")).filter(F.col("names") >= least).select("type", "side", "word", "names")


def accuracy(checks: DataFrame, valid: str = "valid", threshold: float = 0.95) -> DataFrame:
    """By check: valid rows, all rows, their ratio and whether it reaches the threshold."""
    sums = checks.groupBy("check").agg(F.count_if(valid).alias("valid"), F.count("*").alias("total"))
    return sums.withColumn("ratio", F.col("valid") / F.col("total")).withColumn("passed", F.col("ratio") >= threshold)


def symbols_in_place(entities: DataFrame, chunks: DataFrame, slack: int = 3) -> DataFrame:
    """Whether an entity's name stands within `slack` lines of its recorded line: id, valid.

    Lines of a file meet its entities by doc_id; the range test follows the equi join."""
    named = entities.filter("doc_id <> '' and line_start > 0").select("id", "doc_id", "name", F.col("line_start").alias("wanted")).distinct()
    lines = chunks.filter("line_start > 0").select("doc_id", "line_start", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("doc_id", (F.col("line_start") + F.col("at")).alias("n"), "line")
    hits = named.join(lines, (named["doc_id"] == lines["doc_id"]) & F.col("n").between(F.col("wanted") - slack, F.col("wanted") + slack) & F.col("line").contains(F.col("name")))
    return named.join(hits.select(named["id"], F.lit(True).alias("hit")).distinct(), "id", "left").groupBy("id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("valid"))


def missing_symbols(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Function chunks whose name is no entity of their file: doc_id, element_name."""
    told = chunks.filter("element_type = 'function' and element_name <> ''").select("doc_id", "element_name").distinct()
    return told.join(entities.select("doc_id", F.col("name").alias("element_name")).distinct(), ["doc_id", "element_name"], "left_anti")


def imports_together(edges: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of targets imported by the same sources at least `least` times.

    A source that imports very much would make the pairs of its list; each source's list is exploded against itself by an
    equi join on the source, pre-aggregated before the pairs are shuffled."""
    rows = edges.filter("type = 'imports'").select("source_id", "target_id").distinct()
    other = rows.withColumnRenamed("target_id", "other_id")
    pairs = rows.join(other, "source_id").filter("target_id < other_id")
    return pairs.groupBy("target_id", "other_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def query_advice(stats: DataFrame, key: str, slow_ms: float = 100, often: int = 10) -> DataFrame:
    """Keys that are slow on average and frequent: candidates for an index or a partition."""
    return stats.filter((F.col("mean") >= slow_ms) & (F.col("n") >= often)).select(key, "n", "mean")


def token_statistics(df: DataFrame, size: Column) -> DataFrame:
    rows = df.select(size.alias("t"))
    return rows.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.floor(F.avg("t")), F.lit(0)).cast("long").alias("mean"), F.coalesce(F.min("t"), F.lit(0)).cast("long").alias("least"), F.coalesce(F.max("t"), F.lit(0)).cast("long").alias("most"))


def prefix_budget(df: DataFrame, size: Column, budget: int, partition: str, order: list[Column]) -> DataFrame:
    window = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(window)).filter(F.col("used") <= budget)
