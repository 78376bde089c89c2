"""Searches put together from others: by graph, by kind, by likeness; context under a budget; clusters of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.prompts import budget_shares
from lodestrand.functions.text import extension, fuzzy_score, token_estimate
from lodestrand.operators.graph import one_row_each, reach, union_all
from lodestrand.operators.memory import within_budget
from lodestrand.operators.search import cosine, score_of_cosine


def documents_near(edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """doc_id of the entities within `depth` steps of the seeds."""
    nodes = reach(edges, seeds, depth)
    placed = entities.filter("doc_id <> ''").select(F.col("id").alias("node"), "doc_id").distinct()
    return nodes.join(placed, "node").select("doc_id").distinct()


def within_graph(chunks: DataFrame, edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Chunks of documents near the seeds: what a search is then run on."""
    return chunks.join(documents_near(edges, entities, seeds, depth), "doc_id", "left_semi")


def code_only(chunks: DataFrame, language: str | None = None, symbol: str | None = None) -> DataFrame:
    rows = chunks.filter(F.lower("content_type") == "code")
    rows = rows.filter(F.lower(F.trim("language")) == language.lower()) if language else rows
    return rows.filter(F.exists("symbols", lambda s: F.lower(s).contains(symbol.lower())) | F.lower("element_name").contains(symbol.lower())) if symbol else rows


def docs_only(chunks: DataFrame) -> DataFrame:
    """Chunks of documents: by suffix, language, content type or a readme's name."""
    return chunks.filter(extension(F.col("file_path")).isin("md", "rst", "txt", "adoc") | F.lower(F.trim("language")).isin("markdown", "text") | F.lower("content_type").isin("documentation", "prose") | F.lower("file_path").contains("readme"))


def find_similar(entities: DataFrame, chunks: DataFrame, query: str, vector: Column, threshold: float = 0.7, limit: int = 20) -> DataFrame:
    """Entities like a query in passes: vectors above the threshold, vectors above 0.7 of it, entities of the likest chunks'
    files (0.6 of the chunk's score and 0.4 of the name's), likely names. The first pass that finds a name keeps it.

    id, name, score, pass."""
    rows = one_row_each(entities, "name", "file_path", "vector")
    near = score_of_cosine(cosine(F.col("vector"), vector), "distance")
    scored = rows.select("id", "name", "file_path", near.alias("near"), fuzzy_score(query, F.col("name")).alias("like"))
    files = chunks.select("file_path", score_of_cosine(cosine(F.col("vector"), vector), "distance").alias("s")).groupBy("file_path").agg(F.max("s").alias("s"))
    files = files.orderBy(F.desc("s"), "file_path").limit(limit)  # bounded
    bridge = scored.join(F.broadcast(files), "file_path")
    parts = [
        scored.filter(F.col("near") >= threshold).select("id", "name", F.col("near").alias("score"), F.lit(1).alias("pass")),
        scored.filter((F.col("near") < threshold) & (F.col("near") >= 0.7 * threshold)).select("id", "name", F.col("near").alias("score"), F.lit(2).alias("pass")),
        bridge.select("id", "name", (0.6 * F.col("s") + 0.4 * F.col("like")).alias("score"), F.lit(3).alias("pass")),
        scored.filter("like >= 0.4").select("id", "name", F.col("like").alias("score"), F.lit(4).alias("pass")),
    ]
    best = Window.partitionBy("name").orderBy("pass", F.desc("score"), "id")
    found = union_all(parts).withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    return found.orderBy("pass", F.desc("score"), "id").limit(limit)


def context(parts: dict[str, DataFrame], total: int, focus: str = "balanced") -> DataFrame:
    """Context under a token budget: of each part (id, content, score), shared by focus, the best rows as long as they fit."""
    rows = []
    for kind, budget in budget_shares(total, focus).items():
        if kind in parts:
            part = parts[kind].select("id", "content", "score", F.lit(kind).alias("kind"))
            rows.append(within_budget(part, budget, ["kind"], [F.desc("score"), F.col("id")], token_estimate(F.col("content"))))
    return union_all(rows)


def vector_clusters(df: DataFrame, clusters: int, vector: str = "vector", seed: int = 7, examples: int = 3) -> DataFrame:
    """Clusters of vectors by k-means, with the rows nearest to each centre: cluster, id, distance, rank, size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.size(vector) > 0).select("id", array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, seed=seed, maxIter=20).fit(rows)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    told = model.transform(rows).select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v")).join(F.broadcast(centres), "cluster")  # `clusters` rows
    far = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    told = told.select("id", "cluster", far.alias("distance"))
    sizes = told.groupBy("cluster").agg(F.count("*").alias("size"))
    near = told.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "id"))).filter(F.col("rank") <= examples)
    return near.join(F.broadcast(sizes), "cluster")


def layer_gaps(reached: DataFrame, layers: list[str]) -> DataFrame:
    """Layers that none of the entities reached (column layer) belongs to."""
    wanted = reached.sparkSession.createDataFrame([(x,) for x in layers], "layer string")
    return wanted.join(reached.select("layer").distinct(), "layer", "left_anti")
