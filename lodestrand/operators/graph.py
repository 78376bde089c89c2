"""Graph operators over entity and relationship DataFrames.

Searches go level by level: a frontier of distinct nodes meets the edges in a join, and nodes met before are taken out.
Each level is written to the shared folder, so plans stay short and survive lost executors. Edges are cleaned once: types
without case and outer blanks, ends not empty, repeats dropped.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import contains_any, entity_type, file_name, folder, layer, module_path, personal, snake, words_of_name
from lodestrand.plans.scratch import Scratch


def clean_edges(relationships: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Distinct (source_id, target_id, type); links without an end drop out."""
    edges = relationships.select("source_id", "target_id", F.lower(F.trim("type")).alias("type")).filter("source_id <> '' and target_id <> ''")
    return (edges.filter(F.col("type").isin([t.lower() for t in types])) if types else edges).distinct()


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(here, there, type, way) of edges followed forwards, backwards or both ways."""
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "type", F.lit("out").alias("way"))
    back = edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "type", F.lit("in").alias("way"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction: {direction!r}")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def edges_of(relationships: DataFrame, entity: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edges at one entity, each once."""
    ends = {"out": F.col("source_id") == entity, "in": F.col("target_id") == entity}
    return clean_edges(relationships, types).filter(ends["out"] | ends["in"] if direction == "both" else ends[direction])


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """node, depth, parent: everything within `depth` steps of the seeds (column node), seeds at 0, with the least depth and,
    for it, the smallest node it was reached from."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(directed(edges, direction).select("here", "there").distinct(), "links")
    seen = scratch.write(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "level0")
    for step in range(1, depth + 1):
        frontier = seen.filter(F.col("depth") == step - 1).select(F.col("node").alias("here"))
        fresh = frontier.join(links, "here").groupBy("there").agg(F.min("here").alias("parent"))
        fresh = fresh.join(seen.select(F.col("node").alias("there")), "there", "left_anti").select(F.col("there").alias("node"), F.lit(step).alias("depth"), "parent")
        fresh = scratch.write(fresh, f"level{step}")
        seen = seen.unionByName(fresh)
        if not fresh.limit(1).count():
            break
    return seen


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Edges met on the way: here, there, type, way and the depth of `there`'s step."""
    nodes = reach(edges, seeds, depth, direction)
    return directed(edges, direction).join(nodes.filter(F.col("depth") < depth).select(F.col("node").alias("here"), (F.col("depth") + 1).alias("step")), "here")


def paths(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """seed, node, depth, path: every path without repeated nodes of up to `depth` steps. Its size is the number of paths."""
    scratch = Scratch(edges.sparkSession)
    links = scratch.write(directed(edges, direction).select("here", "there").distinct(), "links")
    level = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    found = level = scratch.write(level.distinct(), "level0")
    for step in range(1, depth + 1):
        level = level.join(links, level["node"] == links["here"]).filter(~F.array_contains("path", F.col("there")))
        level = level.select("seed", F.col("there").alias("node"), F.lit(step).alias("depth"), F.concat("path", F.array("there")).alias("path"))
        level = scratch.write(level, f"level{step}")
        found = found.unionByName(level)
    return found


def lineage(edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Leaf paths of the breadth-first tree from the seeds, with the layer of the leaf: node, depth, path, layer, personal."""
    tree = reach(edges, seeds, depth, direction)
    scratch = Scratch(edges.sparkSession)
    grown = scratch.write(tree.filter("depth = 0").select("node", "depth", F.array("node").alias("path")), "grown0")
    every = grown
    for step in range(1, depth + 1):
        level = tree.filter(F.col("depth") == step).join(grown.select(F.col("node").alias("parent"), "path"), "parent")
        grown = scratch.write(level.select("node", "depth", F.concat("path", F.array("node")).alias("path")), f"grown{step}")
        every = every.unionByName(grown)
    leaves = every.join(tree.filter("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    about = entities.groupBy("id").agg(F.min(F.struct("name", "type", "file_path")).alias("e"))
    rows = leaves.join(about, leaves["node"] == about["id"], "left")
    return rows.select("node", "depth", F.array_join("path", " > ").alias("path"), layer(F.col("e.name"), F.col("e.type"), F.col("e.file_path")).alias("layer"), F.coalesce(personal(F.col("e.name")), F.lit(False)).alias("personal"))


def edge_confidence(metadata: Column, kind: Column) -> Column:
    """high, medium, low or inferred: by the confidence in the metadata, else by the type of the link."""
    given = F.coalesce(F.get_json_object(metadata, "$.confidence"), F.get_json_object(metadata, "$.resolution_confidence")).try_cast("double")
    by_type = F.when(kind.isin("defines", "contains", "inherits"), "high").when(kind.isin("calls", "imports", "references"), "medium").otherwise("low")
    return F.when(given >= 0.9, "high").when(given >= 0.7, "medium").when(given >= 0.5, "low").when(given.isNotNull(), "inferred").otherwise(by_type)


def risk(count: Column, personal_count: Column) -> Column:
    """Risk of a change by how much depends on it: critical if personal data do."""
    return F.when(personal_count > 0, "critical").when(count >= 20, "high").when(count >= 5, "medium").otherwise("low")


def impact(edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """What depends on the seeds, by file: file_path, affected, nearest, risk."""
    nodes = reach(edges, seeds, depth, "in").filter("depth > 0")
    about = entities.groupBy("id").agg(F.min(F.struct("file_path", "name")).alias("e"))
    rows = nodes.join(about, nodes["node"] == about["id"], "left").select("node", "depth", F.coalesce("e.file_path", F.lit("")).alias("file_path"), F.coalesce(personal(F.col("e.name")), F.lit(False)).alias("p"))
    sums = rows.groupBy("file_path").agg(F.count("*").alias("affected"), F.min("depth").alias("nearest"), F.count_if("p").alias("p"))
    return sums.select("file_path", "affected", "nearest", risk(F.col("affected"), F.col("p")).alias("risk"))


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Simple cycles of 2 to `longest` nodes, each once, starting at its smallest node: length, path.

    Only nodes above the start are walked to, so every cycle is met in one rotation; nodes without a way in or out can't
    be on one and are taken out first."""
    scratch = Scratch(edges.sparkSession)
    links = edges.filter("source_id <> target_id").select(F.col("source_id").alias("here"), F.col("target_id").alias("there")).distinct()
    for _ in range(3):
        links = links.join(links.select(F.col("there").alias("here")).distinct(), "here", "left_semi")
        links = links.join(links.select(F.col("here").alias("there")).distinct(), "there", "left_semi")
    links = scratch.write(links.select("here", "there"), "links")
    level = links.filter("here < there").select(F.col("here").alias("start"), F.col("there").alias("node"), F.array("here", "there").alias("path"))
    found = None
    for step in range(2, longest + 1):
        closed = level.join(links, (level["node"] == links["here"]) & (level["start"] == links["there"])).select(F.lit(step).alias("length"), F.array_join("path", " > ").alias("path"))
        found = closed if found is None else found.unionByName(closed)
        if step < longest:
            level = level.join(links, level["node"] == links["here"]).filter((F.col("there") > F.col("start")) & ~F.array_contains("path", F.col("there")))
            level = scratch.write(level.select("start", F.col("there").alias("node"), F.concat("path", F.array("there")).alias("path")), f"level{step}")
    return found


# ---------------------------------------------------------------- joins with entities


def one_row_each(entities: DataFrame, *columns: str) -> DataFrame:
    """Entities by id: repeated rows agree but for ranking columns, so the smallest of the chosen columns stands for all."""
    return entities.groupBy("id").agg(F.min(F.struct(*columns)).alias("__e")).select("id", "__e.*")


def dependencies(relationships: DataFrame, entities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Links with what they lead to: source_id, type, target_id, target_name, target_type; links without an entity row drop out."""
    named = one_row_each(entities, "name", "type").select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), entity_type(F.col("type")).alias("target_type"))
    return clean_edges(relationships, types).join(named, "target_id").select("source_id", "type", "target_id", "target_name", "target_type")


def usages(relationships: DataFrame, entities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Links with what uses an entity: target_id, type, source_id, source_name."""
    named = one_row_each(entities, "name").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return clean_edges(relationships, types).join(named, "source_id").select("target_id", "type", "source_id", "source_name")


def broken_links(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct links with an end that is no entity: source_id, target_id, type, missing (source, target or both)."""
    known = entities.select("id").distinct()
    rows = clean_edges(relationships)
    rows = rows.join(known.select(F.col("id").alias("source_id"), F.lit(True).alias("s")), "source_id", "left").join(known.select(F.col("id").alias("target_id"), F.lit(True).alias("t")), "target_id", "left")
    missing = F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").when(F.col("t").isNull(), "target")
    return rows.withColumn("missing", missing).filter("missing is not null").select("source_id", "target_id", "type", "missing")


def isolated(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Ids of entities without any link."""
    ends = clean_edges(relationships).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return entities.select("id").distinct().join(ends, "id", "left_anti")


def relationship_id(*columns: str) -> Column:
    """First 16 digits of the sha256 of the columns, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256), 1, 16)


# --------------------------------------------------------------------- resolution


def path_proximity(source: Column, target: Column) -> Column:
    """Nearness of two files: 1 for one file, 0.8 in one folder, else a tenth less for each step up and down between them, 0.3 at least."""
    x, y = F.split(source, "/"), F.split(target, "/")
    common = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i)))
    steps = F.size(x) + F.size(y) - 2 * common
    return F.when(source == target, 1.0).when(folder(source) == folder(target), 0.8).otherwise(F.greatest(F.lit(0.3), F.round(1.0 - steps * 0.1, 9)))


def _shared_words(a: Column, b: Column) -> Column:
    """How many words of two snake-case names agree."""
    return F.size(F.array_intersect(F.split(a, "_"), F.split(b, "_")))


def naming_score(symbol: Column, path: Column) -> Column:
    """Points for the name of a file against a symbol's: 100 if equal, else 50 if it holds the symbol's, 30 if that holds it, and 10
    for each word of both. Names are compared in snake case."""
    a, b = snake(symbol), snake(F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1"))
    points = F.when(F.contains(b, a), 50.0).otherwise(0.0) + F.when(F.contains(a, b), 30.0).otherwise(0.0) + 10.0 * _shared_words(a, b)
    return F.when(a == b, 100.0).otherwise(points)


def folder_score(symbol: Column, path: Column) -> Column:
    """Points for the folders of a file against a symbol's name: 30 for the file's own folder of that name and 20 for another, else
    10 where one name holds the other, and 5 for each word of both."""
    a, parts = snake(symbol), F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    last = F.size(folders) - 1

    def points(part: Column, i: Column) -> Column:
        b = snake(part)
        exact = F.when(i == last, 30.0).otherwise(20.0)
        return F.when(a == b, exact).when(F.contains(b, a) | F.contains(a, b), 10.0).otherwise(0.0) + 5.0 * _shared_words(a, b)

    return F.aggregate(F.transform(folders, points), F.lit(0.0), lambda s, x: s + x)


def resolve_references(references: DataFrame, entities: DataFrame, frequencies: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The entity each reference (ref_id, name, type, import_path, file_path) means: ref_id, entity_id, strategy, score; null where
    none is found. The first of these that finds one:

    database: `known` (name, file_path, entity_id, score) from an earlier run, for the same file, with a score of 0.5 or more;
    import_path: the one entity of the name (the smallest id) whose module is the import path or ends in it, 0.95;
    exact_match: the name and type of one entity, 1; of n entities whose name is imported somewhere, the smallest id, 0.7 + 0.2 / n;
    proximity: of the entities of the name, the one with the best sum of nearness of files (0.4), naming (0.25), folders (0.15)
    and frequency of the name among imports (0.05, all from 50 on), if that reaches 0.5.

    frequencies: (name, n). References that agree in all but ref_id are resolved once, so a name that many share meets its
    entities once for each file that refers to it."""
    named = one_row_each(entities, "name", "type", "file_path").select(F.col("id").alias("entity_id"), "name", entity_type(F.col("type")).alias("kind"), F.col("file_path").alias("entity_path")).filter("name <> ''")
    keys = ["name", "type", "import_path", "file_path"]
    cases = references.select(*keys).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in keys]
    found = []
    if known is not None:
        found.append(cases.join(known.filter("score >= 0.5"), ["name", "file_path"]).select(*keys, "entity_id", F.lit("database").alias("strategy"), "score", F.lit(1).alias("turn")))
    module, wanted = module_path(F.col("entity_path")), F.col("import_path")
    paths = cases.filter("import_path <> ''").join(named, "name").filter((module == wanted) | module.endswith(F.concat(F.lit("."), wanted)))
    found.append(paths.select(*keys, "entity_id", F.lit("import_path").alias("strategy"), F.lit(0.95).alias("score"), F.lit(2).alias("turn")))
    often = frequencies if frequencies is not None else references.sparkSession.createDataFrame([], "name string, n long")
    kinds = named.groupBy("name", F.col("kind").alias("type")).agg(F.count("*").alias("same"), F.min("entity_id").alias("entity_id")).join(often, "name", "left")
    sure = F.when(F.col("same") == 1, 1.0).when(F.col("n") > 0, 0.7 + 0.2 / F.col("same"))
    kinds = kinds.select("name", F.col("type").alias("kind"), "entity_id", sure.alias("score")).filter("score is not null")
    exact = cases.withColumn("kind", entity_type(F.col("type"))).join(kinds, ["name", "kind"])
    found.append(exact.select(*keys, "entity_id", F.lit("exact_match").alias("strategy"), "score", F.lit(3).alias("turn")))
    near = cases.join(exact.select(*(F.col(c).alias(f"x_{c}") for c in keys)), reduce(lambda a, b: a & b, same), "left_anti").join(named, "name").join(often, "name", "left")
    own = F.col("entity_path")
    score = 0.4 * path_proximity(F.col("file_path"), own) + 0.0025 * naming_score(F.col("name"), own) + 0.0015 * folder_score(F.col("name"), own) + 0.05 * F.least(F.coalesce("n", F.lit(0)) / 50, F.lit(1.0))
    found.append(near.select(*keys, "entity_id", F.lit("proximity").alias("strategy"), score.alias("score"), F.lit(4).alias("turn")).filter("score >= 0.5"))
    rank = F.struct("turn", (-F.col("score")).alias("worse"), "entity_id", "strategy", "score")
    best = union_all(found).groupBy(*keys).agg(F.min(rank).alias("r")).select(*(F.col(c).alias(f"x_{c}") for c in keys), "r")
    return references.join(best, reduce(lambda a, b: a & b, same), "left").select("ref_id", "r.entity_id", "r.strategy", "r.score")


def resolution_statistics(resolved: DataFrame) -> DataFrame:
    """strategy (null for what is unresolved), references, score (mean)."""
    return resolved.groupBy("strategy").agg(F.count("*").alias("references"), F.avg("score").alias("score"))


def _ratios(names: pd.Series, wanted: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, w.lower(), n.lower()).ratio() for n, w in zip(names, wanted)], dtype="float64")


def matching_ratio(name: Column, wanted: Column) -> Column:
    """Twice the characters in matching blocks over all characters of two names, case apart; null where lengths alone keep it below 0.8."""
    shorter, both = F.least(F.length(name), F.length(wanted)), F.length(name) + F.length(wanted)
    return F.when(2 * shorter >= 0.8 * both, F.pandas_udf(_ratios, "double")(F.when(2 * shorter >= 0.8 * both, name).otherwise(""), wanted))


def resolve_entity(entities: DataFrame, name: str, kind: str | None = None, limit: int = 10, fuzzy: float | None = 0.8) -> DataFrame:
    """Candidates for a name, best first: exact 1, case apart 2, same words 3, contained 4, alike 5 (matching blocks reach `fuzzy`)."""
    rows = one_row_each(entities, "name", "type", "file_path")
    if kind:
        rows = rows.filter(entity_type(F.col("type")) == kind)
    wanted = F.array_join(words_of_name(F.lit(name)), " ")
    tier = (
        F.when(F.col("name") == name, 1)
        .when(F.lower("name") == name.lower(), 2)
        .when(F.array_join(words_of_name(F.col("name")), " ") == wanted, 3)
        .when(F.lower("name").contains(name.lower()), 4)
    )
    rows = rows.withColumn("tier", tier).withColumn("ratio", F.lit(None).cast("double"))
    if fuzzy is not None:
        near = rows.filter("tier is null").withColumn("ratio", matching_ratio(F.col("name"), F.lit(name))).filter(F.col("ratio") >= fuzzy).withColumn("tier", F.lit(5))
        rows = rows.filter("tier is not null").unionByName(near)
    return rows.filter("tier is not null").select("id", "name", "type", "file_path", "tier").orderBy("tier", F.desc_nulls_last("ratio"), F.length("name"), "id").limit(limit)


def suggestions(entities: DataFrame, name: str, limit: int = 10, least: float = 0.0) -> DataFrame:
    """The names most like a name by matching blocks, best first: name, ratio."""
    names = entities.select("name").filter("name <> ''").distinct()
    ratio = F.pandas_udf(_ratios, "double")(F.col("name"), F.lit(name))
    return names.withColumn("ratio", ratio).filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "name").limit(limit)


def external_kind(name: Column, kind: Column) -> Column:
    """Category of a symbol from outside: by its type, else by its name."""
    low = F.lower(name)
    return F.when(kind.contains("module"), "module").when(kind.contains("class") | name.rlike("^[A-Z][a-z]"), "class").when(contains_any(low, ["test", "mock"]), "test").when(kind.contains("function"), "function").otherwise("symbol")


def compare_types(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Link types of entity a against b: type, status (present in both, missing from a, extra in a)."""
    of = lambda x: edges.filter((F.col("source_id") == x) | (F.col("target_id") == x)).select("type").distinct()
    left, right = of(a).withColumn("l", F.lit(True)), of(b).withColumn("r", F.lit(True))
    return left.join(right, "type", "full").select("type", F.when(F.col("l").isNull(), "missing").when(F.col("r").isNull(), "extra").otherwise("present").alias("status"))


def service_gaps(connections: DataFrame, services: DataFrame) -> DataFrame:
    """Connections (source, target) whose target isn't a known service (name)."""
    return connections.join(services.select(F.col("name").alias("target")).distinct(), "target", "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def least_confidence(levels: Column) -> Column:
    """The lowest of an array of confidences (high, medium, low, inferred); low for an empty one."""
    ranks = F.transform(levels, lambda x: F.when(x == "high", 3).when(x == "medium", 2).when(x == "low", 1).otherwise(0))
    lowest = F.array_min(ranks)
    return F.when(lowest == 3, "high").when(lowest == 2, "medium").when(lowest == 0, "inferred").otherwise("low")


def uncommitted(pending: DataFrame, committed: DataFrame) -> DataFrame:
    """Pending relationships (by id) that aren't committed yet."""
    return pending.join(committed.select("id").distinct(), "id", "left_anti")
