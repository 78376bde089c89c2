"""Files as DataFrames: listing with ignore rules, hashes, changes, line scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import content_type, extension, language
from lodestrand.operators.graph import union_all

# ---- fixed values: suffixes of files without text
BINARY = "7z avi bin bmp class dll doc docx dylib exe gif gz ico jar jpeg jpg mov mp3 mp4 o obj pdf png pyc so tar wasm webp woff woff2 xls xlsx zip".split()
# ----


def glob_pattern(rule: str) -> str:
    """Regular expression of one line of an ignore file, for paths relative to its folder.

    A slash inside ties the rule to the folder, one at the end means folders; ** crosses folders, * and ? stay within one.
    """
    folder_only, body = rule.endswith("/"), rule.strip("/")
    tied = "/" in body or rule.startswith("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if tied else "(?:^|/)") + out + ("/" if folder_only else "(?:/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a relative path is ignored: the last rule that matches decides, rules with ! take back."""
    test = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            back = rule.startswith("!")
            test = F.when(path.rlike(glob_pattern(rule[1:] if back else rule)), not back).otherwise(test)
    return test


def list_files(spark: SparkSession, root: str, rules: list[str] | None = None, content: bool = False, largest: int | None = None) -> DataFrame:
    """Files below root: path (relative), size, modified, kind, language, and the bytes if asked for.

    Binary suffixes and ignored paths drop out before any content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    path = F.regexp_replace("path", rf"^(?:\w+:)?/*{base.lstrip('/')}/", "")
    rows = rows.withColumn("relative", path).filter(~extension(F.col("relative")).isin(BINARY) & ~ignored(F.col("relative"), rules or []))
    rows = rows.filter(F.col("length") <= largest) if largest else rows
    columns = [F.col("relative").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), content_type(F.col("relative")).alias("kind"), language(F.col("relative")).alias("language")]
    return rows.select(*columns, *([F.col("content")] if content else []))


def hashed(files: DataFrame) -> DataFrame:
    """Files with the sha256 of their content and its text."""
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("text", F.decode("content", "UTF-8"))


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each (project_id, file_path); ties by the larger hash."""
    return states.groupBy("project_id", "file_path").agg(F.max(F.struct("last_updated", "content_hash")).alias("s")).select("project_id", "file_path", "s.content_hash", "s.last_updated")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """project_id, file_path, change (added, changed, deleted) between two states; a null hash counts as changed."""
    a = old.select("project_id", "file_path", F.col("content_hash").alias("before"), F.lit(True).alias("was"))
    b = new.select("project_id", "file_path", F.col("content_hash").alias("after"), F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.coalesce(F.col("before") != F.col("after"), F.lit(True)), "changed")
    return a.join(b, ["project_id", "file_path"], "full").withColumn("change", kind).filter("change is not null").select("project_id", "file_path", "change")


def text_lines(spark: SparkSession, root: str, globs: str = "*") -> DataFrame:
    """Lines of text files: path, line."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs).text(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


# ------------------------------------------------------------------ recognizers


def _found(files: DataFrame, pattern: str, groups: dict[str, int], kind: str) -> DataFrame:
    """One row per match of a pattern in `text`: path, kind and the groups."""
    every = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()]
    rows = files.filter(F.col("text").rlike(pattern)).select("path", "text", *every)
    return rows.select("path", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(*groups)).alias("m")).select("path", "kind", *(F.col(f"m.{n}").alias(n) for n in groups))


# ---- fixed values: how frameworks declare routes
ROUTES = {
    "spring": ("java", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\""),
    "fastapi": ("python", r"@\w+\.(get|post|put|delete|patch|head|options)\s*\(\s*[\"']([^\"']*)[\"']"),
    "express": ("javascript", r"\b(?:app|router)\.(get|post|put|delete|patch|all)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"),
    "nest": ("typescript", r"@(Get|Post|Put|Delete|Patch|All)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"),
}
# ----


def routes(files: DataFrame) -> DataFrame:
    """HTTP routes declared in files (path, text, language): path, kind, method, route. Express also in TypeScript."""
    parts = []
    for kind, (name, pattern) in ROUTES.items():
        names = [name, "typescript"] if kind == "express" else [name]
        parts.append(_found(files.filter(F.col("language").isin(names)), pattern, {"method": 1, "route": 2}, kind))
    rows = union_all(parts)
    method = F.when(F.lower("method") == "request", "any").otherwise(F.lower("method"))
    return rows.select("path", "kind", method.alias("method"), F.regexp_replace(F.concat(F.lit("/"), "route"), "/+", "/").alias("route")).distinct()


def injections(files: DataFrame) -> DataFrame:
    """Spring beans and what they are given: path, kind (bean, field or constructor), name."""
    java = files.filter("language = 'java'")
    beans = _found(java, r"@(?:Component|Service|Repository|Controller|RestController|Configuration)\b[\s\S]{0,200}?class\s+(\w+)", {"name": 1}, "bean")
    fields = _found(java, r"@(?:Autowired|Inject|Resource)\b\s*(?:private|protected|public)?\s*(?:final\s+)?(\w+)(?:<[^>]*>)?\s+\w+\s*;", {"name": 1}, "field")
    return beans.unionByName(fields).distinct()


def queried_objects(files: DataFrame) -> DataFrame:
    """Objects that SOQL in Apex reads: path, kind, name."""
    return _found(files.filter("language = 'apex'"), r"(?i)\[\s*SELECT\b[^\]]*?\bFROM\s+(\w+)", {"name": 1}, "soql").distinct()


def imported_names(files: DataFrame) -> DataFrame:
    """What source files import: path, kind (language), name. Python: the module and each name of a from-import (also in brackets),
    each module of an import. Java: the full name and its last part. JavaScript and TypeScript: the module, the names in braces and
    the default. Go: the path, also in a block, and its last part. Aliases don't count, nor do other languages."""
    name_of = r"([\w.]+)(?:\s+as\s+\w+)?"

    def names(text: Column, pattern: str) -> Column:
        return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))

    def last(full: Column, sign: str) -> Column:
        return F.array(full, F.element_at(F.split(full, sign), -1))

    def each(language: str, pattern: str, groups: dict[str, int], parts) -> DataFrame:
        rows = _found(files.filter(F.col("language") == language), pattern, groups, language)
        return rows.select("path", "kind", F.explode(parts(*(F.col(g) for g in groups))).alias("name"))

    rows = [
        each("python", r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n;#]+)", {"module": 1, "rest": 2}, lambda m, r: F.concat(F.array(m), names(F.regexp_replace(r, r"#[^\n]*", ""), r"(\w+)(?:\s+as\s+\w+)?"))),
        each("python", r"(?m)^[ \t]*import[ \t]+([^\n;#]+)", {"rest": 1}, lambda r: names(r, name_of)),
        each("java", r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+)", {"full": 1}, lambda f: last(f, r"\.")),
        each("go", r"(?m)^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", {"full": 1}, lambda f: last(f, "/")),
        each("go", r"(?m)^[ \t]*import\s*\(([^)]*)\)", {"block": 1}, lambda b: F.flatten(F.transform(names(b, r"\"([^\"]+)\""), lambda f: last(f, "/")))),
    ]
    for language in ("javascript", "typescript"):
        rows.append(each(language, r"(?m)^[ \t]*import\s+([^;'\"]*?)\s*from\s+['\"]([^'\"]+)['\"]", {"what": 1, "module": 2}, lambda w, m: F.concat(F.array(m), names(F.regexp_extract(w, r"\{([^}]*)\}", 1), r"(\w+)(?:\s+as\s+\w+)?"), names(w, r"^(\w+)$"))))
    return union_all(rows).filter("name <> ''").distinct()


def class_bases(files: DataFrame) -> DataFrame:
    """Classes with all their bases and interfaces: path, kind, name, base; without type arguments and keyword arguments."""
    python = _found(files.filter("language = 'python'"), r"(?m)^\s*class\s+(\w+)\s*\(((?:[^()]|\([^()]*\))*)\)", {"name": 1, "bases": 2}, "python")
    named = r"[\w.]+(?:\s*<[^<>]*(?:<[^<>]*>[^<>]*)*>)?"
    pattern = rf"\bclass\s+(\w+)(?:\s*<[^>]*>)?\s+((?:extends|implements)\s+{named}(?:\s*(?:,|\bimplements\b)\s*{named})*)"
    others = _found(files.filter(F.col("language").isin("java", "typescript", "javascript")), pattern, {"name": 1, "bases": 2}, "extends")
    bases = F.regexp_replace("bases", r"#[^\n]*", "")
    for _ in range(4):  # arguments inside arguments
        bases = F.regexp_replace(bases, r"\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>", "")
    bases = F.split(F.regexp_replace(bases, r"\b(?:extends|implements)\s", ","), ",")
    rows = python.unionByName(others).select("path", "kind", "name", F.explode(bases).alias("base"))
    return rows.withColumn("base", F.regexp_replace("base", r"\s+", "")).filter(F.col("base").rlike(r"^[\w.]+$")).distinct()


def salesforce_fields(files: DataFrame) -> DataFrame:
    """Fields of Salesforce object metadata (XML): path, name, type."""
    rows = files.filter(F.col("path").rlike(r"\.(object|field)(-meta\.xml)?$"))
    names, types = F.xpath("text", F.lit("//*[local-name()='fullName']/text()")), F.xpath("text", F.lit("//*[local-name()='type']/text()"))
    return rows.select("path", F.explode(F.arrays_zip(names.alias("name"), types.alias("type"))).alias("f")).select("path", "f.name", "f.type")


# ---------------------------------------------------------------- service discovery


def compose_services(files: DataFrame) -> DataFrame:
    """Services of compose files: path, name, image, port, confidence. A service is a key two blanks deep below `services:`."""
    rows = files.filter(F.col("path").rlike(r"(?i)(^|/)(docker-)?compose[\w.-]*\.ya?ml$"))
    block = F.regexp_extract("text", r"(?m)^services:\s*\n((?:[ \t]+.*\n?|\s*\n)*)", 1)
    parts = F.split(F.concat(F.lit("\n"), block), r"\n  (?=[\w.-]+:\s*(?:\n|$))")
    each = rows.select("path", F.explode(F.slice(parts, 2, 10_000)).alias("part"))
    return each.select(
        "path", F.regexp_extract("part", r"^([\w.-]+):", 1).alias("name"), F.regexp_extract("part", r"(?m)^\s+image:\s*[\"']?([^\s\"']+)", 1).alias("image"),
        F.regexp_extract("part", r"ports:\s*\n\s*-\s*[\"']?(?:\d+:)?(\d+)", 1).try_cast("int").alias("port"), F.lit(0.95).alias("confidence"),
    )


def technology(image: Column, name: Column) -> Column:
    """Kind of a service by its image or name."""
    text = F.lower(F.concat_ws(" ", image, name))
    kinds = {"postgres": "database", "mysql": "database", "mongo": "database", "redis": "cache", "memcached": "cache", "kafka": "queue", "rabbitmq": "queue", "nginx": "proxy", "elasticsearch": "search"}
    out = None
    for part, kind in kinds.items():
        out = F.when(text.contains(part), kind) if out is None else out.when(text.contains(part), kind)
    return out.otherwise("service")


def merged_services(services: DataFrame) -> DataFrame:
    """One row per name: the most confident, then the smallest path."""
    best = F.min(F.struct((-F.col("confidence")).alias("worse"), "path", "image", "port", "confidence"))
    return services.groupBy("name").agg(best.alias("s")).select("name", "s.path", "s.image", "s.port", "s.confidence", technology(F.col("s.image"), F.col("name")).alias("technology"))


def service_mentions(files: DataFrame, services: DataFrame) -> DataFrame:
    """Connections by environment variables such as ORDERS_URL: source (top folder of the file), target, path."""
    names = F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9_]*?)_(?:URL|HOST|ADDR|ENDPOINT)\b"), F.lit(1))
    rows = files.filter(F.col("text").rlike(r"_(URL|HOST|ADDR|ENDPOINT)\b")).select("path", F.explode(F.array_distinct(names)).alias("n"))
    rows = rows.select("path", F.split("path", "/")[0].alias("source"), F.regexp_replace(F.lower("n"), "_", "-").alias("target"))
    return rows.join(services.select(F.col("name").alias("target")).distinct(), "target", "left_semi").filter("source <> target").select("source", "target", "path").distinct()
